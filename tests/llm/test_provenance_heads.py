"""Signatures of tools wherever they stand in a file's leading comments."""

import pytest

from strandweave.llm import provenance

SIGN = "Code generated by protoc-gen-x. DO NOT EDIT."
LICENCE = ["Licensed under the Apache License, Version 2.0;", *[f"line {i} of the licence" for i in range(20)]]
BODY = {"go": "package a\n\nfunc F() int { return 1 }\n", "py": "import os\n\nprint(os.name)\n", "c": "int f(void) { return 1; }\n", "java": "package a;\nclass B {}\n"}
BLOCK = "/*\n" + "\n".join(LICENCE) + "\n*/\n"

SIGNED = [
    ("go", "\n".join("// " + x for x in LICENCE) + f"\n\n// {SIGN}\n" + BODY["go"]),
    ("py", "#!/usr/bin/env python\n" + "\n".join("# " + x for x in LICENCE) + f"\n# {SIGN}\n" + BODY["py"]),
    ("java", BLOCK + f"// {SIGN}\n" + BODY["java"]),
    ("c", "/*\n" + "\n".join(LICENCE) + f"\n{SIGN}\n*/\n" + BODY["c"]),
    ("c", f"/*\n  {SIGN}\n*/\n" + BODY["c"]),
    ("java", f"package a;\n\n/*\n  {SIGN}\n*/\nclass B {{}}\n"),
    ("py", f'"""Messages.\n\n{SIGN}\n"""\n' + BODY["py"]),
    ("py", f'"""{SIGN}"""\n' + BODY["py"]),
    ("py", "\n".join("# " + x for x in LICENCE) + f"\n'''\n{SIGN}\n'''\n" + BODY["py"]),
    ("c", (BLOCK + f"// {SIGN}\n" + BODY["c"]).replace("\n", "\r\n")),
    ("py", "﻿" + "\n" * 15 + f"# {SIGN}\n" + BODY["py"]),
    ("go", f"package a\n// {SIGN}\n"),
    ("java", f" * {SIGN}\n" + BODY["java"]),
    ("py", f"```python\n# {SIGN}\n" + BODY["py"]),
    ("go", f"<<<<<<< HEAD\n// a\n=======\n// {SIGN}\n>>>>>>> b\n" + BODY["go"]),
]
OTHERS = [
    ("py", f'"""Finds files with "{SIGN}" at their head."""\n' + BODY["py"]),
    ("go", BODY["go"] + "\n" * 15 + f"// {SIGN}\n"),
    ("c", "#include <a.h>\n" * 15 + f"/* {SIGN} */\n" + BODY["c"]),
    ("py", "import os\n" * 14 + f'"""\n{SIGN}\n"""\n'),
    ("c", BLOCK + BODY["c"]),
    ("c", "/* open\n" * 3),
    ("py", ""),
    ("py", None),
]


@pytest.mark.parametrize("generated,cases", [(True, SIGNED), (False, OTHERS)])
def test_signatures_anywhere_in_the_leading_comments(spark, generated, cases):
    d = spark.createDataFrame([(i, f"src/f{i}.{ext}", body) for i, (ext, body) in enumerate(cases)], "file_id long, rel_path string, body string")
    up = spark.createDataFrame([("lib/a.c", "int g;")], "rel_path string, body string")
    got = {r.file_id: r.generated for r in provenance.classified_files(d, up).collect()}
    assert got == {i: generated for i in range(len(cases))}
