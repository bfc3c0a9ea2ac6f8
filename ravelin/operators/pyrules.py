"""Python rules P001-P017 as columns over the syntax facts of a file.

Facts of a file stay together in one array, so the two lookups (variable seen in
an enclosing scope, call of a query helper) are local and need no shuffle.
"""

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import pyfacts
from ravelin.functions import text as T
from ravelin.schema import hit, no_hits

cloudpickle.register_pickle_by_value(pyfacts)

# Names the rules look for.
WEAK_HASH_CALLS = ["hashlib.md5", "hashlib.sha1", "md5.new", "sha.new"]
WEAK_HASHES = ["md5", "sha1", "md4"]
WEAK_CIPHERS = ["DES", "DES3", "ARC4", "ARC2", "Blowfish", "RC4", "RC2"]
DESERIALIZERS = [
    "pickle.loads", "pickle.load", "cpickle.loads", "cpickle.load",
    "_pickle.loads", "_pickle.load", "marshal.loads", "marshal.load",
    "dill.loads", "dill.load", "shelve.open",
]
OS_COMMANDS = ["os.system", "os.popen"]
SUBPROCESS_NAMES = ["Popen", "call", "run", "check_output"]
SQL_CALLS = ["execute", "executemany", "executescript", "raw", "extra"]
RANDOM_CALLS = [
    "random", "randint", "randrange", "choice", "getrandbits", "uniform",
    "sample", "shuffle", "choices",
]
SECURITY_NAME = (
    r"(?i:(token|secret|api[_-]?key|passwd|password|pwd|nonce|salt|otp|seed|"
    r"session|csrf|cookie|private|credential))"
)
REQUEST_ACCESS = r"(?i:(args\.get|form\.get|values\.get|\.GET|\.POST|request))"
XML_PARSERS = ["etree.fromstring", "etree.parse", "etree.xml"]
OPENERS = ["os.open", "io.open", "codecs.open"]
UNSAFE_LOADERS = ["", "Loader", "UnsafeLoader"]
SAFE_LOADERS = ["SafeLoader", "FullLoader", "CSafeLoader"]
# Methods that run a statement.
STATEMENT_CALLS = ["execute", "executemany", "executescript"]


def facts(is_python: Column, text: Column) -> Column:
    """Facts of the Python files; all other rows send a null to Python."""
    reader = F.pandas_udf(pyfacts.batch, pyfacts.FACTS)
    return reader(F.when(is_python, text))


def of_kind(all_facts: Column, kind: str) -> Column:
    return F.filter(all_facts, lambda f: f["kind"] == kind)


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def first_arg(call: Column) -> Column:
    return F.try_element_at(call["args"], F.lit(1))


def is_runtime_text(value: Column, call: Column, variables: Column) -> Column:
    """Built on the spot, or a variable of an enclosing scope that was."""
    seen = F.exists(
        variables,
        lambda v: (v["name"] == value["var"])
        & F.array_contains(call["scopes"], v["scopes"][0]),
    )
    return F.coalesce(value["dynamic"] | F.coalesce(seen, F.lit(False)), F.lit(False))


def query_helpers(all_facts: Column) -> Column:
    """Functions that run one of their parameters as a whole statement: name,
    parameter names, and the parameters that are run."""

    def runs_parameter(call, function):
        only = first_arg(call)["var"]
        return (
            call["attr"].isin(STATEMENT_CALLS)
            & (F.size(call["args"]) == 1)
            & (F.size(call["kwargs"]) == 0)
            & F.array_contains(call["scopes"], function["scopes"][0])
            & F.coalesce(F.array_contains(function["names"], only), F.lit(False))
        )

    calls = of_kind(all_facts, "call")
    functions = F.transform(
        of_kind(all_facts, "function"),
        lambda f: F.struct(
            f["name"].alias("name"),
            f["names"].alias("names"),
            F.array_distinct(
                F.transform(
                    F.filter(calls, lambda c: runs_parameter(c, f)), lambda c: first_arg(c)["var"]
                )
            ).alias("sinks"),
        ),
    )
    return F.filter(functions, lambda f: F.size(f["sinks"]) > 0)


def feeds_helper(call: Column, helpers: Column, variables: Column) -> Column:
    """A run-time text reaches the SQL parameter of a helper of this file.

    Of several functions with one name the last counts.
    """
    target = F.element_at(
        F.concat(
            F.array(F.lit(None).cast("struct<names:array<string>,sinks:array<string>>")),
            F.transform(
                F.filter(helpers, lambda h: h["name"] == call["name"]),
                lambda h: F.struct(h["names"].alias("names"), h["sinks"].alias("sinks")),
            ),
        ),
        -1,
    )

    def reached(param):
        place = F.array_position(target["names"], param).cast("int")
        by_place = F.try_element_at(call["args"], place)
        by_name = F.try_element_at(
            F.filter(call["kwargs"], lambda k: k["name"] == param), F.lit(1)
        )
        return F.when(
            by_place.isNotNull(), is_runtime_text(by_place, call, variables)
        ).otherwise(is_runtime_text(by_name, call, variables))

    return F.coalesce(F.exists(target["sinks"], reached), F.lit(False))


def call_rules(c: Column, helpers: Column, variables: Column) -> list:
    """(rule id, condition) in the order in which one call reports them."""
    low = F.lower(c["dotted"])
    one = first_arg(c)
    two = F.try_element_at(c["args"], F.lit(2))
    some = F.size(c["args"]) > 0
    not_text = some & one["text"].isNull()

    def keyword(name, test):
        return F.exists(c["kwargs"], lambda k: (k["name"] == name) & test(k))

    loader = F.coalesce(
        F.try_element_at(F.filter(c["kwargs"], lambda k: k["name"] == "Loader"), F.lit(1))[
            "dotted"
        ],
        F.lit(""),
    )
    xml = F.lit(False)
    for name in XML_PARSERS:
        xml = xml | low.endswith(name)
    return [
        (
            "P001",
            low.isin(WEAK_HASH_CALLS)
            | c["name"].isin(WEAK_HASHES)
            | ((low == "hashlib.new") & F.lower(one["text"]).isin(WEAK_HASHES)),
        ),
        ("P002", (c["attr"] == "new") & last_part(c["receiver"]).isin(WEAK_CIPHERS)),
        ("P004", keyword("verify", lambda k: ~k["truth"])),
        ("P004", keyword("check_hostname", lambda k: ~k["truth"])),
        ("P004", low == "ssl._create_unverified_context"),
        ("P005", low.isin(DESERIALIZERS)),
        (
            "P006",
            low.isin("yaml.load", "yaml.load_all")
            & last_part(loader).isin(UNSAFE_LOADERS)
            & ~F.coalesce(last_part(two["dotted"]), F.lit("")).isin(SAFE_LOADERS),
        ),
        (
            "P007",
            c["name"].isin("eval", "exec") & F.exists(c["args"], lambda a: ~a["const"]),
        ),
        ("P008", low.isin(OS_COMMANDS)),
        (
            "P009",
            (low.startswith("subprocess.") | c["name"].isin(SUBPROCESS_NAMES))
            & keyword("shell", lambda k: k["truth"]),
        ),
        (
            "P010",
            c["attr"].isin(SQL_CALLS) & some & is_runtime_text(one, c, variables),
        ),
        (
            "P011",
            (
                low.endswith("render_template_string")
                | (c["name"] == "mark_safe")
                | (c["attr"] == "mark_safe")
            )
            & not_text,
        ),
        (
            "P013",
            xml
            & (F.size(c["args"]) < 2)
            & ~F.exists(c["kwargs"], lambda k: F.coalesce(k["name"] == "parser", F.lit(False))),
        ),
        (
            "P014",
            ((c["name"] == "open") | low.isin(OPENERS))
            & T.search(one["call"], REQUEST_ACCESS),
        ),
        ("P016", (c["attr"] == "xpath") & one["dynamic"]),
        (
            "P017",
            c["attr"].isin(sorted(pyfacts.LDAP_METHODS))
            & F.exists(c["args"], lambda a: a["dynamic"])
            & ~c["escaped"],
        ),
        ("P015", (c["name"] != "") & feeds_helper(c, helpers, variables)),
    ]


def python_hits(all_facts: Column, text: Column) -> Column:
    """array<HIT> of one Python file, in source order."""

    def of_context(ctx: Column) -> Column:
        def rules_of(f):
            tests = [
                ("P003", (f["kind"] == "attribute") & f["attr"].isin("MODE_ECB", "ECB")),
                (
                    "P012",
                    (f["kind"] == "assign")
                    & F.exists(f["names"], lambda n: T.search(n, SECURITY_NAME))
                    & F.exists(
                        f["calls"],
                        lambda d: (F.substring_index(d, ".", 1) == "random")
                        & last_part(d).isin(RANDOM_CALLS),
                    ),
                ),
            ]
            calls = call_rules(f, ctx["helpers"], ctx["variables"])
            tests += [(rule, (f["kind"] == "call") & broken) for rule, broken in calls]
            return F.array_compact(
                F.array(*[F.when(broken, F.lit(rule)) for rule, broken in tests])
            )

        def emit(f, rule, k):
            line = F.coalesce(F.try_element_at(ctx["lines"], f["line"]), F.lit(""))
            return hit(
                rule_id=rule,
                line=f["line"],
                evidence=T.strip(line),
                seq=f["rank"].cast("bigint") * 100 + k,
            )

        return F.flatten(
            F.transform(
                ctx["facts"],
                lambda f: F.transform(rules_of(f), lambda rule, k: emit(f, rule, k)),
            )
        )

    context = F.struct(
        all_facts.alias("facts"),
        of_kind(all_facts, "variable").alias("variables"),
        query_helpers(all_facts).alias("helpers"),
        T.splitlines(text).alias("lines"),
    )
    return F.when(F.size(all_facts) > 0, T.bind(context, of_context)).otherwise(no_hits())
