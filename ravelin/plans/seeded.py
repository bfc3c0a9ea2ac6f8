"""``seeded_files``: the documents table as a source tree.

The driver tables hold prose and no code.  So each document gets one snippet
from a fixed list of under 200 by ``doc_id % n`` and keeps its whole text behind
it; the number of files, their lines and the work grow with the table.

How the text is attached depends on the file type: as it is (``raw``), as
comment lines (``hash``), or as a JSON string (``json``, where the snippet holds
a %s).
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.plans.corpus import CORPUS, EXTENSION
from ravelin.sources.files import from_table
from ravelin.sources.tables import read_table, spread

ADDR = "Ab3" * 15  # 45 characters of an address
BECH = "q0z9" * 9 + "abc"  # 39 characters of an address

# (file name, how the text is attached, snippet)
OTHER = [
    # comments and near misses
    ("note.js", "raw", "// eval(x) in a comment\n/* md5 */\nconst evaluate = retrieval(x);"),
    ("two.java", "raw", "  * new ObjectInputStream(x)\nint key = new Random().nextInt();\nvar c = Cipher.getInstance(\"aes/ecb/pkcs5\");"),
    ("twice.php", "raw", "<?php eval($a); $h = sha1($a); eval($b);"),
    # vendored
    ("node_modules/lib.js", "raw", "const v = eval(expr);"),
    ("build/gen.go", "raw", "h := md5.New()"),
    # hidden payloads
    ("b64.py", "hash", "blob = 'aW1wb3J0IG9zOyBvcy5zeXN0ZW0oJ2lkJyk='\nsafe = 'aGVsbG8gd29ybGQgdGhpcyBpcyBvaw=='"),
    ("hex.js", "raw", "const p = \"\\x65\\x76\\x61\\x6c\\x28\\x31\\x29\\x3b\";"),
    ("chr.py", "hash", "x = (chr(101)+chr(118)+\n  chr(97) + chr(108))\ny = chr(65)+chr(66)+chr(67)"),
    ("codes.js", "raw", "const a = 1;\nconst f = String.fromCharCode(101, 118,\n 97, 108);\nconst g = String.fromCharCode(72, 105, 33);"),
    ("split.js", "raw", "run('ev' + 'al', 'x');\nrun('sa' + 'fe');"),
    # secrets
    ("app.env", "raw", "db_password = \"Zx81kQ0pLm29VbTr5-Yw\"\nname = \"plain-value-here\"\nregion: 'US_EAST_REGION_PRIMARY_1'"),
    ("keys.py", "hash", "secret_key = 'q9W8e7R6t5Y4u3I2o1P0aSdFgHjK'\nnote = 'abcdefghijklmnopqrst'\nmonkey = 'Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8'"),
    ("ids.conf", "raw", "token = \"3f2b8c1e-9a4d-4c7b-8e6f-1a2b3c4d5e6f\"\nhash: \"9e107d9d372bb6826bd81d3542a419d6\"\n; token = \"Zx81kQ0pLm29VbTr5-Yw\""),
    ("bare.js", "raw", "call(\"tG7kP2xQ9mZ4vB8nL1cR6wY3sD5fH0jA\", 'test_placeholder_value_1234');"),
    # Terraform
    ("store.tf", "raw", "resource \"aws_s3_bucket\" \"b\" {\n  bucket = \"logs\"\n}"),
    ("enc.tf", "raw", "resource \"aws_s3_bucket\" \"b\" {\n  server_side_encryption_configuration {}\n}"),
    ("net.tf", "raw", "resource \"aws_security_group\" \"g\" {\n  ingress {\n    from_port = 22\n    to_port   = 22\n    protocol  = \"tcp\"\n    cidr_blocks = [\"0.0.0.0/0\"]\n  }\n}"),
    ("far.tf", "raw", "resource \"aws_security_group\" \"g\" {\n  from_port = 22\n\n\n\n\n\n\n  cidr_blocks = [\"0.0.0.0/0\"]\n}"),
    ("cred.tf", "raw", "  Password = \"hunter22\"\n  token = \"${var.token}\"\n  secret = \"again\""),
    # CloudFormation and Kubernetes
    ("cf.yaml", "hash", "AWSTemplateFormatVersion: '2010-09-09'\nResources:\n  Gate:\n    Type: AWS::EC2::SecurityGroup\n    Properties:\n      SecurityGroupIngress:\n        - {FromPort: 22, CidrIp: 0.0.0.0/0}\n        - {FromPort: '22', CidrIp: '::/0'}\n        - {FromPort: 443, CidrIp: 0.0.0.0/0}"),
    ("cfref.yaml", "hash", "Resources:\n  Gate:\n    Type: AWS::EC2::SecurityGroup\n    Properties:\n      VpcId: !Ref Vpc\n      SecurityGroupIngress:\n        - {FromPort: 22, CidrIp: 0.0.0.0/0}"),
    ("pod.yml", "hash", "apiVersion: apps/v1\nkind: Deployment\nspec:\n  template:\n    spec:\n      containers:\n        - name: web\n          securityContext: {privileged: true}\n        - name: side\n      initContainers:\n        - name: init\n          securityContext: {privileged: true}"),
    ("bare.yml", "hash", "apiVersion: v1\nkind: Pod\nspec:\n  containers:\n    - name: web\n      securityContext: {privileged: true}"),
    ("null.yaml", "hash", "apiVersion: v1\nkind: Thing\nspec: null"),
    # TON
    ("wallet.fc", "raw", "() recv_internal(slice in_msg) {\n  int r = random();\n  int t = now() % 7;\n  repeat(100) { step(); }\n  slice a = addr_none;\n}"),
    ("safe.func", "raw", "() recv_internal(slice in_msg) {\n  slice s = in_msg~load_msg_addr();\n  if (bounced$(s)) { return (); }\n}"),
    ("addr.tolk", "raw", f"fun owner() {{\n  return \"EQ{ADDR}\";\n  mnemonic = \"word word word\";\n}}"),
    # Solidity
    ("old.sol", "raw", "pragma solidity ^0.6.12;\ncontract Old {\n  function pay(address a) public {\n    a.call{value: 1}(\"\");\n    balances[a] = 0;\n  }\n}"),
    ("auth.sol", "raw", "pragma solidity ^0.8.1;\ncontract Auth {\n  function end() external {\n    require(tx.origin == owner);\n    selfdestruct(owner);\n  }\n  uint256 total = first + second;\n}"),
    ("guard.sol", "raw", "pragma solidity 0.7.0;\nusing SafeMath for uint;\nfunction end() public view {\nonlyOwner\n  selfdestruct(a);\n  // selfdestruct(b);\n  if (block.timestamp >= limit) revert();\n}"),
    ("call.sol", "raw", "contract C {\n  function f() public returns (bool) {\n    (bool success,) = a.call(data);\n    require(success);\n    for (uint i = 0; i < list.length; i++) {}\n    bytes32 h = keccak256(abi.encodePacked(a, b));\n    address s = ecrecover(h, v, r, t);\n  }\n}"),
    ("init.sol", "raw", "contract P {\n  function initialize(address o) public {\n    owner = o;\n    impl.delegatecall(data);\n    admin = msg.sender;\n    string secret_key = \"abcdefgh1234\";\n  }\n}"),
    # Solana and CosmWasm
    ("prog.rs", "raw", "use solana_program::account_info::AccountInfo;\npub fn process_instruction(a: &AccountInfo) {\n    total += amount;\n    invoke(&target_info.clone(), accounts);\n    let d = Data::try_from_slice_unchecked(&a.data);\n}"),
    ("good.rs", "raw", "use anchor_lang::prelude::*;\n#[account(signer)]\npub fn process_instruction(a: Signer<'_>) {\n    total = total.checked_add(1);\n    count += 1;\n    invoke_signed(&ix, accounts, seeds);\n}"),
    ("cw.rs", "raw", f"use cosmwasm_std::SubMsg;\npub fn execute (deps: Deps) {{\n    STATE.save(deps.storage, &s);\n    let m = SubMsg::new(msg);\n    let a = \"cosmos1{BECH[1:]}\";\n}}\npub fn reply (deps: Deps) {{}}"),
    ("cwok.rs", "raw", "use cw_storage_plus::Item;\npub fn execute (deps: Deps, info: MessageInfo) {\n    let admin = ADMIN.load(deps.storage);\n    nonpayable(&info);\n}\npub fn reply (m: Reply) { if msg.id == 1 {} }"),
    # manifests
    ("requirements.txt", "raw", "# pinned\nDjango==4.1.0\nflask>=2.0,<3\nrequests[socks]~=2.28 ; python_version>'3'\n-r other.txt\ngit+https://x.example/y\nuvicorn"),
    ("dev-requirements.txt", "raw", "pyyaml === 5.3\nnumpy\nlodash==1"),
    ("package.json", "json", "{\"name\": \"web\", \"keywords\": %s, \"dependencies\": {\"Lodash\": \"^4.17.20\", \"express\": \">= 4.18.0\"}, \"devDependencies\": {\"semver\": \"~7.5.0\"}, \"optionalDependencies\": {\"ws\": \"8.0.0\"}}"),
    ("go.mod", "raw", "module example.com/app\n\nrequire (\n\tgithub.com/Acme/Moment v1.2.3\n\tgolang.org/x/tar v0.4.1-rc // indirect\n)\nrequire one.example/y v2.0.0"),
    ("Cargo.toml", "raw", "[dependencies]\nserde = \"1.0.150\"\nTokio = { features = [\"full\"], version = \"1.21\" }\nws = \"0.9.2\"\nlocal = { path = \"../l\" }"),
    ("Gemfile", "raw", "gem 'rails', '~> 6.1'\ngem \"puma\"\ngem 'pg', '>= 1.1'"),
    ("Pipfile", "raw", "[packages]\njinja2 = \"*\"\ntornado = \">=6.1\"\nidna = *"),
]


def snippets() -> list:
    """(sid, name, attach, snippet, case_id, side, cwe, language, modelled)."""
    rows = []
    for case, lang, cwe, bad, good, modelled in CORPUS:
        how = "hash" if lang == "python" else "raw"
        for side, code in (("vulnerable", bad), ("secure", good)):
            name = f"{case}-{side}{EXTENSION[lang]}"
            rows.append((name, how, code, case, side, cwe, lang, modelled))
    rows += [(name, how, code, None, None, None, None, None) for name, how, code in OTHER]
    return [(i, *row) for i, row in enumerate(rows)]


SNIPPET_SCHEMA = (
    "sid int, name string, attach string, snippet string, case_id string, "
    "side string, cwe string, language string, modelled boolean"
)


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snippets()
    table = F.broadcast(spark.createDataFrame(rows, SNIPPET_SCHEMA))
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = docs.withColumn("sid", F.pmod("doc_id", F.lit(len(rows))).cast("int")).join(
        table, "sid"
    )
    as_comment = F.concat(F.lit("\n# "), F.regexp_replace("text", T.LINE_END, "\n# "))
    content = (
        F.when(F.col("attach") == "json", F.replace("snippet", F.lit("%s"), F.to_json(F.array("text"))))
        .when(F.col("attach") == "hash", F.concat("snippet", as_comment))
        .otherwise(F.concat_ws("\n", "snippet", "text"))
    )
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("/"), F.col("name"))
    return joined.withColumns({"path": path, "content": content})


def seeded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(_seeded(spark, sf_dir), F.col("path"), F.col("content"))


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, case_id, side, cwe, language, modelled of the labelled files."""
    return (
        _seeded(spark, sf_dir)
        .where(F.col("case_id").isNotNull())
        .select("path", "case_id", "side", "cwe", "language", "modelled")
    )
