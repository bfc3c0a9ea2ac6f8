"""Infrastructure as code: Terraform by text, CloudFormation and Kubernetes by
YAML facts."""

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions import yamlfacts
from ravelin.operators.contracts import at_line, window
from ravelin.schema import hit, no_hits

cloudpickle.register_pickle_by_value(yamlfacts)

# Terraform patterns.
TF_CREDENTIAL = (
    r"(?i:\b(password|secret|api_key|token|private_key|access_key)"
    r"\s*=\s*\"[^\"${}][^\"]*\")"
)
TF_OPEN = r"0\.0\.0\.0/0"


def yaml_kind(ext: Column, text: Column) -> Column:
    """cloudformation, kubernetes or null; the suffix is case-sensitive."""
    return F.when(
        ext.isin(".yml", ".yaml"),
        F.when(
            text.contains("AWSTemplateFormatVersion") | text.contains("AWS::"),
            "cloudformation",
        ).when(text.contains("apiVersion") & text.contains("kind"), "kubernetes"),
    )


def yaml_facts(kind: Column, text: Column, tolerant: bool = False) -> Column:
    """Facts of the YAML files; other rows send only nulls to Python."""
    reader = F.pandas_udf(yamlfacts.make_facts(tolerant), yamlfacts.FACTS)
    return reader(kind, F.when(kind.isNotNull(), text))


def terraform_hits(text: Column) -> Column:
    bucket = F.when(
        text.contains("aws_s3_bucket") & ~text.contains("server_side_encryption"),
        hit(
            rule_id=F.lit("IAC-TF-001"),
            line=F.lit(0),
            evidence=F.lit("server_side_encryption_configuration not found"),
            seq=F.lit(0),
        ),
    )

    def of_lines(lines):
        ssh = F.filter(
            T.numbered(lines),
            lambda x: (x["s"].contains("from_port") | x["s"].contains("to_port"))
            & x["s"].contains("22")
            & F.exists(window(lines, x["n"], 4, 5), lambda s: s.rlike(TF_OPEN)),
        )
        credential = F.filter(
            T.numbered(lines), lambda x: T.search(x["s"], TF_CREDENTIAL)
        )
        return F.concat(
            F.when(
                text.contains("aws_security_group"),
                F.transform(
                    F.slice(ssh, 1, 1), lambda x: at_line("IAC-TF-002", x, F.lit(1))
                ),
            ).otherwise(no_hits()),
            F.transform(
                F.slice(credential, 1, 1),
                lambda x: at_line(
                    "IAC-TF-008",
                    x,
                    F.lit(2),
                    F.regexp_replace(
                        T.strip(x["s"]), T.rx(r"=\s*\"[^\"]+\""), '= "***"'
                    ),
                ),
            ),
        )

    return F.concat(
        F.array_compact(F.array(bucket)), T.bind(T.splitlines(text), of_lines)
    )


def is_open_ssh(fact: Column) -> Column:
    return (
        (fact["kind"] == "ingress")
        & (fact["port"] == "22")
        & fact["cidr"].isin("0.0.0.0/0", "::/0")
    )


def is_privileged(fact: Column) -> Column:
    return (fact["kind"] == "container") & fact["privileged"]


def fact_hits(facts: Column) -> Column:
    """CloudFormation and Kubernetes hits from the facts of one file."""
    open_ssh = F.transform(
        F.filter(facts, is_open_ssh),
        lambda f, k: hit(
            rule_id=F.lit("IAC-CF-001"),
            line=F.lit(0),
            evidence=F.concat(F.lit("SecurityGroupIngress port 22 CidrIp "), f["cidr"]),
            seq=k,
            message=F.concat(
                F.lit("Security group '"), f["name"], F.lit("' opens SSH to "), f["cidr"]
            ),
        ),
    )
    privileged = F.transform(
        F.filter(facts, is_privileged),
        lambda f, k: hit(
            rule_id=F.lit("IAC-K8S-005"),
            line=F.lit(0),
            evidence=F.lit("securityContext.privileged: true"),
            seq=k,
            message=F.concat(F.lit("Container '"), f["name"], F.lit("' is privileged")),
        ),
    )
    return F.concat(open_ssh, privileged)


def iac_hits(ext: Column, text: Column, facts: Column) -> Column:
    return F.when(ext == ".tf", terraform_hits(text)).otherwise(
        F.coalesce(fact_hits(facts), no_hits())
    )
