"""Line and Python rules against brute force and stated cases."""

import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ravelin.operators import linerules as L
from ravelin.functions import text as T
from ravelin.plans import scan
from ravelin.plans.corpus import CORPUS, EXTENSION
from ravelin.sources.files import LANGUAGE, MAX_SOURCE_BYTES, is_scannable

NEAR_MISSES = {
    "javascript": ["x.eval(1)", "  // eval(x)", "medieval(x)", "a.innerHTML = b;", "eval (y)", "spawn('a' + b)"],
    "go": ["sha1.NewCipher(k)", "exec.CommandContext(c, fmt.Sprintf(x))", "q.Exec(a + b)", "# md5.New()"],
    "java": ["GETINSTANCE(\"des/cbc\")", "Random r = new Random();", "csrf = new Random ()", "x.compile(\"a\" + b)", "* new Random() token"],
    "php": ["$x->md5($a)", "sha1 ($b)", "exec('a')", "exec('a' . $b)", "$d->exec(\"x $y\")", "$q->evaluate('a' . $b)"],
    "ruby": ["eval x", "X::eval(y)", "`ls #{d}`", "%x{ls #{d}}", "a.order(\"#{c}\")", "Digest::SHA1.new", "Digest::SHA128"],
    "csharp": ["new DESCryptoServiceProvider()", "c.CommandText = $\"x\"", "x.CommandText = \"a\" + b", "n.SelectSingleNode(@\"a\" + b)"],
    "kotlin": ["getinstance(\"rc4\")", "ProcessBuilder(\"a\" + b)", "db.execute(\"${x}\")"],
    "rust": ["md5::compute(x)", "c.args(&format!(\"x\"))", "query_as(format!(\"x\"))", "subquery(format!(\"x\"))"],
    "cpp": ["gets(b)", "budgets(b)", "system(a + b)", "EVP_sha1()", "xsprintf(a)"],
}


def brute_force(language, text):
    for n, line in enumerate(text.splitlines(), 1):
        if re.match(T.COMMENT_CODE, line):
            continue
        for rule, pattern in L.RULES[language]:
            if re.search(pattern, line) and (
                rule not in L.GATES or re.search(L.GATES[rule], line)
            ):
                yield n, rule, line.strip()[:200]


def test_line_packs_equal_brute_force(spark, files):
    texts = {}
    for case, lang, _, bad, good, _ in CORPUS:
        if lang != "python":
            texts[f"s/{case}-a{EXTENSION[lang]}"] = bad
            texts[f"s/{case}-b{EXTENSION[lang]}"] = good
    for lang, lines in NEAR_MISSES.items():
        texts[f"s/near{EXTENSION[lang]}"] = "\r\n".join(lines) + "\x0b" + lines[0] + "\n"
    want = sorted(
        (path, *hit)
        for path, text in texts.items()
        for hit in brute_force(LANGUAGE["." + path.rsplit(".", 1)[1]], text)
    )
    got = rows(scan.detect(files(texts), ["lines"]), "file", "line", "rule_id", "evidence")
    assert got == want
    assert {r[2] for r in got} == {r for p in L.LANGUAGES for r, _ in L.RULES[p]}


def test_solidity_pack_equals_brute_force(spark, files):
    lines = [
        "a.call{value: 1}(\"\");", "a.call{value: 1}(\"\"); require(ok);", "owner = msg.sender;",
        "owner =  msg.sender;", "admin = x;", "function f() public view {", "function f() external {",
        "function f(uint a) public returns (bool) {", "// selfdestruct(a)", "selfdestruct (a);",
        "uint8 x = a + b;", "revert( );", "for (uint i = 0; i < list.length; i++) {", "# tx.origin == a",
    ]
    text = "\n".join(lines)
    want = sorted(
        (n, rule, line.strip()[:120])
        for n, line in enumerate(lines, 1)
        for rule, pattern in L.SOLIDITY
        if re.search(pattern, line) and not line.strip().startswith(("//", "/*", "*"))
    )
    got = scan.detect(files({"c.sol": text}), ["solidity"])
    assert rows(got, "line", "rule_id", "evidence") == want
    # rule by rule, not line by line
    order = [r.rule_id for r in got.orderBy("seq").collect()]
    assert order == sorted(order)


def test_corpus_recall_and_false_positives(spark, files):
    texts = {}
    for case, lang, _, bad, good, _ in CORPUS:
        texts[f"s/{case}-bad{EXTENSION[lang]}"] = bad
        texts[f"s/{case}-good{EXTENSION[lang]}"] = good
    found = scan.detect(files(texts), ["python", "lines"])
    by_file = {}
    for file, cwe in rows(found, "file", "cwe"):
        by_file.setdefault(file, set()).add(cwe)
    for case, lang, cwe, _, _, modelled in CORPUS:
        hit = cwe in by_file.get(f"s/{case}-bad{EXTENSION[lang]}", set())
        assert hit == modelled, case
        assert f"s/{case}-good{EXTENSION[lang]}" not in by_file, case


PYTHON_CASES = [
    ("def f(c, a):\n    s = 'x %s' % a\n    def g():\n        c.execute(s)\n", [(4, "P010")]),
    ("def f(c, a):\n    s = 'x %s' % a\ndef g(c, s):\n    c.execute(s)\n", []),
    ("s = f'a{b}'\nclass K:\n    def m(self, c):\n        c.raw(s)\n", [(4, "P010")]),
    ("class K:\n    s = 'a' + b\n    def m(self, c):\n        c.extra(s)\n", [(4, "P010")]),
    ("s: str = 'a {}'.format(b)\ntry:\n    pass\nfinally:\n    c.executemany(s)\n", [(5, "P010")]),
    ("try:\n    pass\nexcept E:\n    s = 'a' + b\nc.execute(s)\n", [(5, "P010")]),
    ("def run(c, x, q):\n    c.execute(q)\nrun(c, 1, q='a' + b)\nrun(c, 1, 'ok')\n", [(3, "P015")]),
    ("def run(c, q):\n    c.execute(q)\ndef run(c, q):\n    c.execute(q, 1)\nrun(c, 'a' + b)\n", [(5, "P015")]),
    ("def run(c, q):\n    c.execute(q, 1)\nrun(c, 'a' + b)\n", []),
    ("requests.get(u, verify=False, check_hostname=False)\n", [(1, "P004"), (1, "P004")]),
    ("DES.new(k, DES.MODE_ECB)\n", [(1, "P002"), (1, "P003")]),
    ("Crypto.Cipher.ARC4.new(k)\nAES.new(k)\n", [(1, "P002")]),
    ("yaml.load(s, yaml.SafeLoader)\nyaml.load(s, Loader=yaml.UnsafeLoader)\nyaml.load_all(s, Loader)\n", [(2, "P006"), (3, "P006")]),
    ("eval('1')\neval(x)\nexec()\nm.eval(x)\n", [(2, "P007")]),
    ("call(x, shell=True)\ncall(x, shell=1)\no.run(x, shell=True)\n", [(1, "P009")]),
    ("a.mark_safe(x)\nmark_safe('x')\nflask.render_template_string(x)\n", [(1, "P011"), (3, "P011")]),
    ("my_token, b = random.random(), 1\nsalt = other = [random.choice(x)]\nroll = random.random()\n", [(2, "P012")]),
    ("etree.parse(f)\netree.parse(f, p)\netree.XML(f, parser=p)\nlxml.etree.xml(f)\n", [(1, "P013"), (4, "P013")]),
    ("io.open(request.form.get('x'))\nopen(flask.request())\nopen(x)\n", [(1, "P014"), (2, "P014")]),
    ("c.search_ext(b, s, f'({x})')\nc.search_s(b, s, '(%s)' % dn.escape_dn_chars(x))\n", [(1, "P017")]),
    ("hashlib.new('MD5')\nmd5(x)\nHASHLIB.SHA1(x)\nhashlib.new(n)\n", [(1, "P001"), (2, "P001"), (3, "P001")]),
    ("x = (\n", []),
    ("x = 'a\0b'\n", []),
]


def test_python_rules(spark, files):
    texts = {f"p{i:02d}.py": code for i, (code, _) in enumerate(PYTHON_CASES)}
    want = sorted((f"p{i:02d}.py", *h) for i, (_, hits) in enumerate(PYTHON_CASES) for h in hits)
    assert rows(scan.detect(files(texts), ["python"]), "file", "line", "rule_id") == want


def test_size_and_folder_limits(spark, files):
    code = "h := md5.New()\n"
    texts = {
        "a.go": code, "vendor/a.go": code, "x/build/a.go": code, "a.txt": code, "A.GO": code,
        "big.go": code + "//" + "x" * 1_500_000,
    }
    assert rows(scan.detect(files(texts), ["lines"]), "file") == [("A.GO",), ("a.go",), ("big.go",)]
    small = files(texts).where(is_scannable(F.col("rel"), F.col("ext"), F.col("length"), MAX_SOURCE_BYTES))
    assert rows(small, "path") == [("A.GO",), ("a.go",)]


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, files, parts):
    texts = {f"f{i}.js": "eval(a); exec(`x ${y}`);\n" * (i + 1) for i in range(9)}
    found = scan.scan(files(texts).repartition(parts))
    assert found.count() == 2 * sum(range(1, 10))


def test_added_rules(spark, files):
    added = [("MY1", "go", r"\bpanic\(", "CWE-1", "LOW", "Panics"), ("MY2", "ruby", "raise", "CWE-2", "HIGH", "Raises"), ("MY3", "go", "panic", "CWE-3", "LOW", "x")]
    found = scan.detect_added(files({"a.go": "panic(x)\n// panic(y)", "b.rb": "raise", "c.py": "raise"}), added)
    assert rows(found, "file", "line", "rule_id", "cwe", "severity") == [
        ("a.go", 1, "MY1", "CWE-1", "LOW"), ("a.go", 1, "MY3", "CWE-3", "LOW"), ("b.rb", 1, "MY2", "CWE-2", "HIGH")]


def test_split_prefilter_and_patterns_are_one_generated_stage(spark, files, capsys):
    """Patterns stand in generated code above the scan, and the text is split once for all packs."""
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        scan.detect(files({"a.go": "x"}), ["lines", "solidity", "contracts", "secrets"]).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
    out = capsys.readouterr().out
    stage = next(s for s in out.split("== Subtree") if "posexplode" in s)
    plan, code = stage.split("Generated code:")
    lines = [line for line in plan.splitlines() if re.search(r"Generate |Filter |Project ", line)]
    assert lines and all("*(" in line for line in lines)
    assert "InsecureSkipVerify" in plan and "RLIKE" in plan and ".matcher(" in code
    assert plan.count("posexplode(") == 1


def test_packs_of_one_pass_do_not_disturb_each_other(spark, files):
    """All packs together find what each finds alone, with rare line ends, bad bytes and long files."""
    texts = {
        "a.sol": "x = tx.origin == y;\r\nrequire(tx.origin == z); selfdestruct(a);\n" + "a.call(x);\n" * 400,
        "b.rs": "use solana_program::x;\nlet d = try_from_slice_unchecked(&a);\x0ctotal += 1;\nMd5::new();",
        "c.js": "eval(x); // token = 'Zx81kQ0pLm29VbTr5-Yw'\nrun('ev' + 'al', token = \"Zx81kQ0pLm29VbTr5-Yw\");\x85eval(y)",
        "d.go": "md5.New()\n# md5.New()\n" + "plain\n" * 1000 + "md5.New()", "e.fc": "() f() { int r = random(); }", "f.js": "",
    }
    df = files(texts)
    columns = ["file", "line", "rule_id", "seq", "evidence"]
    apart = sorted(r for p in scan.PACKS for r in rows(scan.detect(df, [p]), *columns))
    assert rows(scan.detect(df), *columns) == apart and len(apart) > 400
    assert ("d.go", 1003, "G001") in [r[:3] for r in apart]
