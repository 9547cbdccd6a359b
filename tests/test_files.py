from pyspark.sql import functions as F

from strandweave.extract.symbols import extract_text, file_stem, make_id
from strandweave.functions import text as T
from strandweave.operators import detect, extraction, ingest
from strandweave.pipeline import generate
from strandweave.streaming import watch


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]).select(column).first()[0]


def test_text_functions(spark):
    c = F.col("s")
    assert [one(spark, T.normalize_id(c), s=x) for x in ("Hello World!", "__foo__bar__", "a.b.c", "Kelvin", "", None)] == ["hello_world", "foo_bar", "a_b_c", "elvin", "", None]
    assert one(spark, T.word_count(c), s="a b\r\n c ") == 3 and one(spark, T.word_count(c), s=None) == 0 and one(spark, T.word_count(c), s="  ") == 0
    assert one(spark, T.estimate_tokens(c), s="é" * 6) == 3 and one(spark, T.estimate_tokens(c), s="") == 1
    assert one(spark, T.digest(c), s=" SHA256:AB cd ") == "abcd" and one(spark, T.digest(c), s=" ") is None
    assert one(spark, T.forward_path(c), s=".\\a\\b.py") == "a/b.py"
    assert one(spark, T.file_stem(c), s="src/foo.py") == "src.foo" and file_stem("src/foo.py") == "src.foo"
    assert one(spark, T.make_id(c, F.lit("bar")), s="__foo__") == "foo_bar" and make_id("__foo__", "bar") == "foo_bar"
    assert one(spark, T.strip_call(c), s="main()()") == "main"
    assert one(spark, T.xml_escape(c), s="<a&'\">") == "&lt;a&amp;&apos;&quot;&gt;"
    assert one(spark, T.wiki_filename(c), s="a/b: c?") == "a-b-_c_"


def test_types_and_urls(spark):
    f = lambda p, t=None: one(spark, detect.file_type(F.col("p"), F.col("t")), p=p, t=t)
    assert [f("a/b.PY"), f("x.pdf"), f("x.svg"), f("x.mp3"), f("x.yml"), f("x.bin"), f("noext")] == ["code", "paper", "image", "video", "document", None, None]
    assert f("x.md", "arXiv: abstract, we propose") == "paper" and f("x.md", "plain") == "document"
    u = lambda x: one(spark, ingest.url_type(F.col("u")), u=x)
    assert [u("https://netflix.com/a"), u("https://arxiv.org/abs/1706.03762"), u("https://h.org/a.pdf?x=1"), u("https://h.org/a")] == ["tweet", "arxiv", "pdf", "webpage"]
    assert one(spark, ingest.url_type_strict(F.col("u")), u="https://netflix.com/a") == "webpage"
    bad = lambda x: one(spark, ingest.unsafe_url(F.col("u")), u=x)
    assert [bad("ftp://h.org"), bad("http://10.0.0.1/x"), bad("http://172.20.1.1"), bad("http://metadata.google.internal/"), bad("http://[::1]/"), bad("https://h.org")] == ["scheme", "internal address", "internal address", "metadata host", "internal address", None]
    html = "<title> A \n b</title><style>p{}</style><script>x()</script><p>Hi  &amp;<b>you</b>"
    assert one(spark, ingest.html_to_text(F.col("h")), h=html) == "A b Hi &amp; you" and one(spark, ingest.html_title(F.col("h"), F.lit("u")), h=html) == "A b"


def test_ignore_rules_last_match_wins(spark, rows):
    r = detect.IgnoreRules(["# c", "*.log", "/build", "docs/x", "!keep.log", "  "])
    paths = ["a.log", "b/keep.log", "build/x", "s/build/x", "docs/x/y", "s/docs/x"]
    want = [True, False, True, False, True, False]
    # a leading slash anchors like an inner one
    r2 = detect.IgnoreRules(["*.log", "/build/**", "docs/x", "!keep.log"])
    assert [r2.ignored(p) for p in paths] == want
    d = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [x[0] for x in d.select(r2.column(F.col("p"))).collect()] == want
    assert r.ignored("a.log")


def test_scan_extract_and_generate(spark, tmp_path, rows):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nclass A(Base):\n    def go(self):\n        return helper(1)\n")
    (tmp_path / "src" / "b.py").write_text("def helper(x):\n    return x\n\ndef main():\n    return helper(2)\n")
    (tmp_path / "src" / "bad.py").write_text("def (:\n")
    (tmp_path / "node_modules" / "x.js").write_text("x")
    (tmp_path / "my_token.py").write_text("x")
    (tmp_path / ".graphignore").write_text("*.txt\n")
    (tmp_path / "n.txt").write_text("x")
    found = detect.detect(spark, str(tmp_path))
    assert rows(found, "rel_path", "file_type") == [("my_token.py", None), ("src/a.py", "code"), ("src/b.py", "code"), ("src/bad.py", "code")]
    assert detect.detection_summary(found).first().n_sensitive == 1
    g = generate(spark, str(tmp_path))
    assert {"src_a_py", "src_a_a", "src_a_a_go", "src_b_helper", "src_b_main"} <= {r.id for r in g.nodes.collect()}
    calls = {(r.orig_src, r.orig_tgt, r.confidence) for r in g.edges.where("relation = 'calls'").collect()}
    assert calls == {("src_a_a_go", "src_b_helper", "INFERRED"), ("src_b_main", "src_b_helper", "EXTRACTED")}
    (tmp_path / "src" / "b.py").unlink()
    assert "src_b_helper" not in {r.id for r in generate(spark, str(tmp_path), update=True).nodes.collect()}
    assert (tmp_path / "graph-out" / "report.md").exists()


def test_extractors_of_other_languages():
    cases = {
        "m/a.ts": ("import { x } from './m';\nexport class Foo extends Bar {\n  constructor(a) { this.go(); }\n  go() {\n    return helper();\n  }\n}\nfunction helper() { }\nconst arrow = (a) => run(a);\n", {".go()", "helper()", "Foo", "arrow()"}, {("inherits", "bar"), ("imports_from", "m")}),
        "m/a.go": ('package m\nimport "fmt"\ntype T struct {\n}\nfunc (t *T) Run() {\n\tfmt.Println()\n}\nfunc Free() {\n\tRun()\n}\n', {"T", ".Run()", "Free()"}, {("imports", "fmt")}),
        "m/a.rs": ("use std::fmt;\nstruct S;\ntrait Tr { }\nimpl Tr for S {\n    fn go(&self) { free(); }\n}\nfn free() {}\n", {"S", "Tr", ".go()", "free()"}, {("implements", "tr"), ("imports", "std_fmt")}),
        "m/A.java": ("import java.util.List;\npublic class A extends B implements C {\n    public A() { init(); }\n    int go(int x) {\n        return run(x);\n    }\n}\n", {"A", ".go()"}, {("inherits", "b"), ("implements", "c")}),
        "m/a.c": ("#include <stdio.h>\nstruct P {\n  int x;\n};\nstatic int go(int a) {\n    return run(a);\n}\n", {"P", "go()"}, {("imports", "stdio_h")}),
        "m/a.rb": ("require 'json'\nclass A < B\n  def go\n    run(1)\n  end\nend\n", {"A", ".go()"}, {("inherits", "b"), ("imports", "json")}),
        "m/a.cs": ("using System.IO;\nnamespace N {\npublic class A : B {\n    public int Go(int x) {\n        return Run(x);\n    }\n}\n}\n", {"A", ".Go()", "N"}, {("inherits", "b"), ("imports", "system_io")}),
        "m/a.cpp": ("#include <v>\nclass A : public B {\n  int go(int x) {\n    return run(x);\n  }\n};\nint free_fn(int y) {\n  return y;\n}\n", {"A", ".go()", "free_fn()"}, {("inherits", "b")}),
    }
    for path, (text, labels, edges) in cases.items():
        f = extract_text(path, text)
        assert labels <= {x[1] for x in f.nodes}, (path, f.nodes)
        assert edges <= {(e[2], e[1]) for e in f.edges}, (path, f.edges)
        assert f.stubs, path
    assert extract_text("a.kt", "x") is None and extract_text("a.py", None).nodes == [("a_py", "a.py", 1)]


def test_cache_and_manifest(spark, rows, tmp_path):
    f = spark.createDataFrame([("a.md", "---\nx: 1\n---\nbody"), ("b.md", "body")], "rel_path string, body string")
    hashes = f.select("rel_path", ingest.file_hash(F.col("body"), F.col("rel_path")).alias("hash"))
    cache = hashes.where("rel_path = 'a.md'").select("hash", F.lit("ast").alias("kind"), F.lit("{}").alias("fragment"))
    extraction.save_cache(cache, str(tmp_path / "cache"))
    back = spark.read.parquet(str(tmp_path / "cache"))
    touched = spark.createDataFrame([("a.md", "---\nx: 2\n---\nbody"), ("b.md", "body")], "rel_path string, body string")
    assert rows(extraction.cache_misses(touched, back), "rel_path") == [("b.md",)] and extraction.cache_hits(touched, back).count() == 1
    a = spark.createDataFrame([("n", "1", "code"), ("c", "2", "code"), ("s", "3", "document")], "rel_path string, hash string, file_type string")
    b = spark.createDataFrame([("c", "x", "code"), ("s", "3", "paper"), ("d", "4", "code")], "rel_path string, hash string, file_type string")
    assert rows(detect.manifest_status(a, b)) == [("c", "changed", "code"), ("d", "deleted", "code"), ("n", "new", "code"), ("s", "unchanged", "paper")]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.py").write_text("x")
    (src / "b.md").write_text("y")
    seen = []
    q = watch.watch_files(spark, str(src), lambda df, n: seen.append((n, df.count(), df.agg(F.bool_or(F.col("path").endswith(".md"))).first()[0])), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    (src / "c.py").write_text("z")
    watch.watch_files(spark, str(src), lambda df, n: seen.append((n, df.count(), None)), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [x[1] for x in seen] == [2, 1]
    (tmp_path / "ev").mkdir()
    rate = spark.readStream.schema("ts timestamp, k string").json(str(tmp_path / "ev"))
    (tmp_path / "ev" / "1.json").write_text('{"ts":"2026-01-01T00:00:00","k":"a"}\n{"ts":"2026-01-01T00:00:01","k":"a"}\n{"ts":"2026-01-01T01:00:00","k":"a"}\n')
    (tmp_path / "ev" / "2.json").write_text('{"ts":"2026-01-01T09:00:00","k":"a"}\n')
    out = watch.debounced(rate, "ts", ["k"], "3 seconds", "10 minutes").writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    out.awaitTermination()
    assert sorted(r.n for r in spark.sql("select n from bursts").collect())[-1] == 2


def test_two_streams_meet_within_a_gap(spark, tmp_path):
    for name, rows in (("a", '{"k":"x","ts":"2026-01-01T00:00:05","v":1}\n{"k":"y","ts":"2026-01-01T00:00:05","v":2}\n{"k":null,"ts":"2026-01-01T00:00:05","v":3}\n'), ("b", '{"k":"x","ts":"2026-01-01T00:00:01"}\n{"k":"y","ts":"2025-12-31T23:00:00"}\n{"k":"x","ts":"2026-01-01T00:00:06"}\n{"k":null,"ts":"2026-01-01T00:00:04"}\n')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.json").write_text(rows)
    a, b = spark.readStream.schema("k string, ts timestamp, v int").json(str(tmp_path / "a")), spark.readStream.schema("k string, ts timestamp").json(str(tmp_path / "b"))
    out = watch.joined_within(a, b, ["k"], "ts", "10 seconds", "1 hour").writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    out.awaitTermination()
    assert [r.v for r in spark.sql("select v from met").collect()] == [1]
    a, b = (spark.read.schema("k string, ts timestamp, v int").json(str(tmp_path / x)) for x in "ab")
    assert [r.v for r in watch.joined_within(a, b.select("k", "ts"), ["k"], "ts", "10 seconds").collect()] == [1]
