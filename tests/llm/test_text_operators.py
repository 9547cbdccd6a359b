import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import lookalike, packing, provenance, repetition, tokenizer

NODES = "ord long, id string, label string, repo string, class string, looks string"
DOCS = "doc_id long, text string, lang string, source string, share string, x string"


# -- tokens


@pytest.fixture(scope="module")
def vocabulary():
    return tokenizer.loaded(tokenizer._file(None))


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(tokenizer.default_vocabulary())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids_equal_the_library_and_edits_are_exact(vocabulary, reference):
    random.seed(5)
    letters = "abcé ß日本 \n\t　\x1c'st123٣½—<|endoftext|>ＡＢ   zz"
    for _ in range(1500):
        s = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        ids = reference(s)
        assert vocabulary.encode(s) == ids, s
        c = random.randint(0, len(s))
        assert vocabulary.append(s[:c], vocabulary.encode(s[:c]), s[c:]) == ids
        a = random.randint(0, len(s))
        b = random.randint(a, len(s))
        assert vocabulary.edit(s, ids, a, b, "xé ") == vocabulary.encode(s[:a] + "xé " + s[b:])
    for s in ("a" * 3000, " " * 5000, "the" * 2000, "日本語" * 1000, "<|endoftext|>"):
        assert vocabulary.encode(s) == reference(s)


def test_prefix_tables_grow_by_appends(vocabulary):
    data = "internationalization".encode()
    whole = vocabulary.prefix_table(data)
    for cut in range(1, len(data)):
        assert vocabulary.prefix_table(data, vocabulary.prefix_table(data[:cut]), cut) == whole
        assert vocabulary.walk_back(vocabulary.prefix_table(data[:cut])) == vocabulary.walk_back(whole[: cut + 1])


def test_token_operator_on_odd_rows(spark, reference):
    long = "word " * 30000
    d = spark.createDataFrame([(1, None, *[None] * 4), (2, "", *[None] * 4), (3, "Hello", "en", "s", "a", "b"), (3, "Hello", *[None] * 4), (4, long, *[None] * 4)], DOCS)
    got = [(r.doc_id, list(r.ids)) for r in tokenizer.token_ids(d).collect()]
    assert got[:4] == [(1, []), (2, []), (3, reference("Hello")), (3, reference("Hello"))] and got[4][1] == reference(long)
    assert [r.n_tokens for r in tokenizer.token_counts(d).collect()] == [len(x[1]) for x in got]
    assert tokenizer.token_ids(d.limit(0)).count() == 0


# -- packing


def _check(counts, capacity):
    got, used = {}, {}
    for size, n, first, each in packing.pack_sizes(counts, capacity):
        got[size] = got.get(size, 0) + n
        for i in range(n):
            used[first + i // each] = used.get(first + i // each, 0) + size
    assert got == {s: n for s, n in counts.items() if n}
    assert all(u <= capacity for u in used.values()) and set(used) == set(range(len(used)))
    return len(used)


def _optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= items[i]}:
            k = rooms.index(r)
            place(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_packing_is_close_to_the_optimum():
    random.seed(2)
    gap = 0
    for _ in range(150):
        capacity = random.randint(8, 30)
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 8))]
        counts = {s: items.count(s) for s in items}
        gap += _check(counts, capacity) - _optimum(items, capacity)
    assert 0 <= gap <= 2
    big = {i: 1 + 2_000_000 // (i + 50) for i in range(1, 2049)}
    n = sum(math.ceil(i * c / 2048) for i, c in big.items())
    assert len(packing.pack_sizes(big, 2048)) < 50_000 and n > 0


@pytest.mark.parametrize("salts", [1, 64])
def test_pack_operator(spark, monkeypatch, salts):
    monkeypatch.setattr(packing, "SALTS", salts)
    random.seed(4)
    sizes = [(i, random.choice([0, None, 1, 3, 7, 10, 11, 25])) for i in range(300)] + [(7, 3)]
    d = spark.createDataFrame(sizes, "doc_id long, n_tokens long")
    w = spark.createDataFrame([("a", 10), ("b", 25), ("a", 10), ("c", 0), ("d", None)], "window_name string, capacity long")
    out = packing.pack_documents(d, w).collect()
    for name, c in (("a", 10), ("b", 25)):
        rows = [r for r in out if r.window_name == name]
        used = {}
        for r in rows:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        assert max(used.values()) <= c and len(used) <= math.ceil(sum(n or 0 for _, n in sizes) / c) + 2
        assert sorted((r.doc_id, r.n_tokens) for r in rows if r.part == 0 and r.n_tokens < c) == sorted((i, n or 0) for i, n in sizes if (n or 0) < c)
        assert sum(r.n_tokens for r in rows) == sum(n or 0 for _, n in sizes)
        assert all(r.n_tokens == c for r in rows if r.part and any(q.doc_id == r.doc_id and q.part > r.part for q in rows))
    full = [r for r in out if r.n_tokens == r.capacity]
    assert all(sum((q.window_name, q.container_id) == (r.window_name, r.container_id) for q in out if q.n_tokens) == 1 for r in full)
    assert all({r.container_id for r in out if r.window_name == n} == set(range(len({r.container_id for r in out if r.window_name == n}))) for n in "ab")
    huge = packing.pack_documents(spark.createDataFrame([(1, 10**6 + 3), (1, 10**6 + 3), (2, 0)], "doc_id long, n_tokens long"), w.where("window_name = 'a'")).collect()
    assert len(huge) == 2 * (10**5 + 1) + 1 and len({r.container_id for r in huge}) == 2 * 10**5 + 1 and {r.n_tokens for r in huge if r.part == 10**5} == {3}
    assert packing.pack_documents(d.limit(0), w).count() == 0 and packing.pack_documents(d, w.limit(0)).count() == 0
    assert {r.window_name for r in packing.fill_report(packing.pack_documents(d, w)).collect()} == {"a", "b"}


# -- look-alikes


def test_lookalike_pairs(spark, rows):
    labels = ["move node", "mоve node", "ｍｏｖｅ　ｎｏｄｅ", "mo​ve node", "Move node", "mové node", "mové node", "move node1", "move  node", "ﬁx", "fix", "tiệng", "tiệng", "tiệng", "ё", "ë", "", None]
    d = spark.createDataFrame([(i, f"id{i:02}", x, "r", "c", "l") for i, x in enumerate(labels)] + [(90, "id90", "move node", "other", None, None), (91, "id00", "move node", "r", None, None), (92, None, "move node", "r", None, None), (93, "id93", "fix", None, None, None), (94, "id94", "ﬁx", None, None, None)], NODES)
    got = rows(lookalike.lookalike_pairs(d))
    groups = [[0, 1, 2, 3], [5, 6], [9, 10], [11, 12, 13], [14, 15]]
    assert got == sorted((f"id{a:02}", f"id{b:02}") for g in groups for a, b in itertools.combinations(g, 2))
    c = {r.ord: r.canonical for r in lookalike.canonical_labels(d).collect()}
    assert len(c) == d.count() and {c[i] for i in groups[0]} == {"move node"} and c[10] == c[9] == "fix" and c[17] is None and c[16] == ""
    assert c[6] == c[5] and unicodedata.normalize("NFC", c[13]) == c[12] == c[11] == c[13]
    assert lookalike.lookalike_pairs(d.limit(0)).count() == 0
    hot = spark.range(4000).select(F.col("id").alias("ord"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.lit("main()" * 500).alias("label"), F.lit("r").alias("repo"))
    assert lookalike.lookalike_pairs(hot).count() == 0


@pytest.mark.parametrize("a, b, same", [
    ("𝐚pex", "apex", True), ("ɑpex", "apex", True), ("ɡate", "gate", True), ("Ⅰtem", "Item", True), ("aⅽt", "act", True), ("Ⅱ", "II", True), ("ﬄ", "ffl", True), ("𝚨", "A", True), ("ⲟꓟ", "oM", True), ("ǆ", "dž", True),
    ("x²", "x2", False), ("①", "1", False), ("ſet", "set", False), ("ϑ", "θ", False), ("a\u0600", "a", False), ("a\u200d", "a", True), ("½", "1/2", False), ("Ç", "C", False), ("µ", "μ", True),
])
def test_what_looks_the_same(spark, a, b, same):
    d = spark.createDataFrame([(1, "i", a, "r"), (2, "j", b, "r")], "ord long, id string, label string, repo string")
    assert lookalike.lookalike_pairs(d).count() == same


# -- repetition


def test_measures():
    share = lambda t: (lambda m: m[1] / m[0] if m[0] else 0)(repetition.measure(t))
    s = "One sharp batch must produce fairly. "
    assert share("") == 0 and share("12 34 !!") == 0 and share(s) == 0
    assert abs(share(s * 4) - 0.75) < 1e-9 and abs(share(s + s.upper().replace(".", " 12) -")) - 0.5) < 1e-9
    assert share("a\nb\na\n") == pytest.approx(1 / 3) and share("spam " * 50) > 0.9
    assert share("密な索引は固い緩衝を調べる。" * 3) == pytest.approx(2 / 3)
    assert share("a lead " + "diagram" * 40) > 0.9 and share("a " + "".join(map(chr, range(0x10A0, 0x10A0 + 30))) * 2) > 0.4
    random.seed(5)
    assert share("".join(random.choice("abcdefghijkl") for _ in range(5000))) < 0.01
    assert share("x y z. p q r.\n\nx y z. p q r.\n\n") == 0.5
    assert share(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))) == 0


def test_repetitive_documents_stand_out_even_in_a_source_of_nothing_else(spark, rows):
    words = [f"{a}{b}ra" for a in "bcdfghjklm" for b in "aeiou"]
    random.seed(1)
    text = lambda n: " ".join(random.choice(words) for _ in range(n)) + "."
    data = []
    for i in range(240):
        bad = i % 8 == 0 or i >= 160
        base = text(12) + " "
        data.append((i, base * 5 if bad else " ".join(text(12) for _ in range(5)), "en", "spam" if i >= 160 else "good", None, None))
    data += [(900, None, "en", "good", None, None), (901, "", None, None, None, None), (902, "one", None, None, None, None), (903, "aa bb cc dd ee. " * 3000, None, None, None, None)]
    d = spark.createDataFrame(data, DOCS)
    want = {x[0] for x in data if x[1] and (lambda m: m[0] and m[1] / m[0] >= 0.4)(repetition.measure(x[1]))}
    assert {r.doc_id for r in repetition.repetitive_documents(d).collect()} == want and {160, 0, 903} <= want
    assert repetition.repetition_shares(d).count() == len(data) and repetition.repetitive_documents(d.limit(0)).count() == 0


def test_minimum_covariance_withstands_contamination():
    draw = np.random.default_rng(3)
    root = np.array([[0.2, 0, 0, 0], [0.1, 0.15, 0, 0], [0, 0.05, 0.2, 0], [0.1, 0, 0, 0.3]])
    clean = draw.normal(size=(6000, 4)) @ root.T + [0.5, 0.4, 0.6, 1.0]
    x = np.concatenate((clean, draw.normal(size=(1500, 4)) * 0.2 + [1.5, 1.5, 1.5, 3.0]))
    center, scatter = repetition.minimum_covariance(np.ones(len(x)), x, x[:, :, None] * x[:, None, :])
    assert np.abs(center - [0.5, 0.4, 0.6, 1.0]).max() < 0.03
    assert np.abs(scatter - np.eye(4) * repetition.WIDTH**2 - root @ root.T).max() < 0.02
    # sums in cells give what single documents give, but for the cell at the border
    cells = {}
    for row in x:
        cells.setdefault(tuple(np.floor(row / repetition.WIDTH)), []).append(row)
    n = np.array([len(c) for c in cells.values()], dtype=float)
    s = np.array([np.sum(c, axis=0) for c in cells.values()])
    p = np.array([np.einsum("ki,kj->ij", c, c) for c in map(np.array, cells.values())])
    by_cell = repetition.minimum_covariance(n, s, p)
    assert np.abs(by_cell[0] - center).max() < 0.02 and np.abs(by_cell[1] - scatter).max() < 0.01


def test_estimates_of_sources(spark):
    """A source of nothing but repetition takes its language's estimate, a small one too, and a usual one its own."""
    data = [("en", "good", [0.01 * (i % 9), 0.0, 0.0, 0.5 + 0.01 * (i % 50)]) for i in range(200)]
    data += [("en", "spam", [1.2, 1.2, 1.1, 2.0 + 0.01 * (i % 7)]) for i in range(150)] + [("en", "few", [0.0, 0.0, 0.0, 0.7])] * 3 + [(None, None, [0.1, 0.0, 0.0, 0.6])]
    d = spark.createDataFrame([(i, *x, 10) for i, x in enumerate(data)], "doc_id long, lang string, source string, x array<double>, n_letters long")
    level = {(r.lang, r.source): r.level for r in repetition.estimates(d).collect()}
    assert level == {("en", "good"): 2, ("en", "spam"): 1, ("en", "few"): 1, (None, None): 0}
    far = {r.source for r in repetition.robust_distances(d).where(f"distance > {repetition.CUTOFF}").select("source").distinct().collect()}
    assert far == {"spam"}


# -- provenance


def test_grammars():
    a = np.array([1, 2, 3, 4] * 16 + [9, 8, 7], dtype=np.int64)
    f = np.zeros(len(a), dtype=np.int64)
    left, rules = provenance.grammar_sizes(a, f, 1)
    assert left[0] + 2 * rules[0] < 0.45 * len(a)
    b = np.arange(1, 200, dtype=np.int64)
    assert provenance.grammar_sizes(b, np.zeros(len(b), dtype=np.int64), 1)[0][0] == len(b)
    # a passage has the same rules wherever it stands
    random.seed(3)
    body = np.array([random.randint(1, 10**9) for _ in range(400)], dtype=np.int64)
    other = np.concatenate((np.array([5, 6, 7]), body, np.array([1, 2])))
    r1, _, n1 = provenance.content_rules(body, np.zeros(len(body), dtype=np.int64))
    r2, _, n2 = provenance.content_rules(other, np.zeros(len(other), dtype=np.int64))
    assert n1.sum() == 400 and n2[np.isin(r2, r1)].sum() > 320
    two = np.concatenate((body, body))
    owners = np.repeat([0, 1], 400)
    r3, o3, _ = provenance.content_rules(two, owners)
    assert list(r3[o3 == 0]) == list(r3[o3 == 1]) == list(r1)


def test_grammars_do_not_depend_on_the_batch():
    random.seed(8)
    files = [np.array([random.randint(1, random.choice((3, 20, 1000))) for _ in range(random.randint(0, 300))], dtype=np.int64) for _ in range(40)] + [np.full(37, 5), np.array([1, 1, 1]), np.array([2, 2, 3, 2, 2])]
    owner = np.repeat(np.arange(len(files)), [len(f) for f in files])
    left, rules = provenance.grammar_sizes(np.concatenate(files), owner, len(files))
    for i, f in enumerate(files):
        one = provenance.grammar_sizes(f, np.zeros(len(f), dtype=np.int64), 1)
        assert (left[i], rules[i]) == (one[0][0], one[1][0])
        assert left[i] <= len(f) and (len(f) < 2 or left[i] + rules[i] <= len(f))
    # 37 equal symbols: five doublings, and the odd ones stay
    assert (left[40], rules[40]) == (3, 5) or left[40] <= 6
    assert (left[41], rules[41]) == (3, 0) and (left[42], rules[42]) == (3, 1)


def test_features_do_not_depend_on_partitions(spark, rows):
    random.seed(9)
    line = lambda: f"x{random.randint(0, 9)} = f(y{random.randint(0, 9)}, {random.randint(0, 99)})\n"
    d = spark.createDataFrame([(i, f"a{i}.py", "".join(line() for _ in range(random.randint(0, 60)))) for i in range(60)], "file_id long, rel_path string, body string")
    up = d.where("file_id < 3").select("rel_path", "body")
    one, many = (rows(provenance.file_features(d.repartition(n), up)) for n in (1, 16))
    assert one == many


def test_rules_shared_across_repos(spark):
    random.seed(10)
    w = lambda: "".join(random.choice("bcdfglmnprst") + random.choice("aeiou") for _ in range(3))
    body = lambda: "".join(f"def {w()}({w()}):\n    {w()} = {w()} + {random.choice('cdefg')}.{w()}()\n" for _ in range(40))
    same = body()
    data = [(1, "r", same), (2, "s", "# a copy\n" + same), (3, "r", body()), (4, None, body()), (5, "s", ""), (6, "s", None), (7, "t", "x = 1\n"), (8, "u", "x = 1\n")]
    d = spark.createDataFrame([(i, r, "a.py", b, 1) for i, r, b in data], "file_id long, repo string, rel_path string, body string, several int")
    got = {r.file_id: r for r in provenance.shared_rules(d).collect()}
    assert {i for i, r in got.items() if r.vendored} == {1, 2} and got[1].shared_share > 0.9 and got[3].shared_share < 0.3 and got[4].repo is None and not {5, 6} & set(got)
    assert provenance.shared_rules(d.limit(0)).count() == 0


def test_file_classes(spark, rows):
    random.seed(6)
    w = lambda: "".join(random.choice("bcdfglmnprst") + random.choice("aeiou") for _ in range(3))
    hand = lambda n=30: "".join(f"def {w()}({w()}, {w()}):\n    {w()} = {w()}.{w()}({w()}, {random.randint(1, 999)})\n    return {w()}\n\n" for _ in range(n))
    lib = hand(40)
    made = "".join(f"class {w().title()}{i:03}(object):\n    __slots__ = ('_f{i}', '_f{i + 1}')\n    _tag = {i}\n" for i in range(40))
    data = "V = [" + ", ".join(f"{random.random():.6f}" for _ in range(200)) + "]\n"
    mini = "!function(e,t){" + "".join(f"var {random.choice('abcdef')}{i}={random.choice('xyz')}.{random.choice('mnop')}({i});" for i in range(80)) + "}(this);"
    files = [
        (1, "r", "a.py", hand()), (2, "r", "gen.py", made), (3, "r", "x.js", mini), (4, "r", "third_party/lib-1.0/a.py", hand()), (5, "r", "deep/copy.py", "# header\n" + lib.replace("\n", "\r\n")), (6, "r", "t.py", data),
        (7, "r", "signed.py", "#!/usr/bin/env python3\n# Code generated by tool. DO NOT EDIT.\n" + hand()), (8, "r", "trap.py", '# the writer puts "DO NOT EDIT" on top of the files it generates; this one is edited by people\n' + hand()),
        (9, "r", "app/vendors/a.py", hand()), (10, "r", "small.py", hand(6) + "T = [1, 2, 3, 4, 5, 6, 7, 8, 9]\n"), (11, "r", "empty.py", ""), (12, "r", None, None), (13, "r", "external/x.py", hand()), (14, None, "n_pb2.py", "x = 1\n"),
    ]
    d = spark.createDataFrame([(*x, "c", "d") for x in files], "file_id long, repo string, rel_path string, body string, generated string, head string")
    up = spark.createDataFrame([("a.py", lib), ("b.py", None)], "rel_path string, body string")
    got = {r.file_id: (r.generated, r.minified, r.vendored, r.blob) for r in provenance.classified_files(d, up).collect()}
    marks = {2: 0, 3: 1, 4: 2, 5: 2, 6: 3, 7: 0, 14: 0}
    for i, c in got.items():
        assert (i in marks) == any(c) and (i not in marks or c[marks[i]]), (i, c)
    assert {r.file_id for r in provenance.not_handwritten(d, up).collect()} == set(marks)
    assert provenance.classified_files(d.limit(0), up).count() == 0 and provenance.classified_files(d, up.limit(0)).count() == 14
    many = {r.file_id for r in provenance.not_handwritten(d, up).collect()}
    old, provenance.MAX_SHARED_RULES = provenance.MAX_SHARED_RULES, 1
    try:
        assert {r.file_id for r in provenance.not_handwritten(d, up).collect()} == many
    finally:
        provenance.MAX_SHARED_RULES = old
