"""The two readers as table functions, callable LATERAL from SQL.

    register(spark)
    SELECT f.path, p.line FROM files f, LATERAL python_facts(f.content) p WHERE p.name = 'eval'

Facts become rows, so rules on them are plain predicates.
"""

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ravelin.functions import pyfacts, yamlfacts

cloudpickle.register_pickle_by_value(pyfacts)
cloudpickle.register_pickle_by_value(yamlfacts)


def row_type(facts: str) -> str:
    """The struct of one fact, from the type of an array of them."""
    return facts.removeprefix("array<").removesuffix(">")


class PythonFacts:
    """(source) -> a row per fact of a Python file; none for null."""

    def eval(self, source: str):
        if source is not None:
            for fact in pyfacts.facts_of(source):
                yield tuple(fact[name] for name in pyfacts.EMPTY)


class YamlFacts:
    """(kind, content) -> a row per fact of a YAML file of that kind; none for null."""

    def __init__(self):
        import yaml

        self.loader = yaml.SafeLoader

    def eval(self, kind: str, content: str):
        if kind is not None and content is not None:
            yield from yamlfacts.facts_of(kind, content, self.loader)


def register(spark: SparkSession) -> None:
    """Make ``python_facts(text)`` and ``yaml_facts(kind, text)`` known to the session's SQL."""
    spark.udtf.register("python_facts", udtf(PythonFacts, returnType=row_type(pyfacts.FACTS), useArrow=True))
    spark.udtf.register("yaml_facts", udtf(YamlFacts, returnType=row_type(yamlfacts.FACTS), useArrow=True))
