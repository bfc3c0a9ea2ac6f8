"""YAML documents to facts.  Needs a YAML parser, hence Python; the rules that
read the facts are columns (see operators/iac.py)."""

import pandas as pd

FACTS = (
    "array<struct<kind:string,name:string,port:string,cidr:string,privileged:boolean>>"
)


GROUP = "AWS::EC2::SecurityGroup"  # fixed value


def _ingress(doc):
    resources = (doc["Resources"] or {}).items()
    for name, group in resources:
        if isinstance(group, dict) and group.get("Type") == GROUP:
            listed = (group.get("Properties") or {}).get("SecurityGroupIngress")
            for rule in filter(lambda r: isinstance(r, dict), listed or []):
                yield "ingress", str(name), _port(rule.get("FromPort")), str(rule.get("CidrIp")), None


def _port(value):
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def _containers(doc):
    pod = doc
    for step, key in enumerate(["spec", "template", "spec"]):
        if step == 2 and not isinstance(pod, dict):
            return
        pod = pod.get(key, {})
    for kind in ("containers", "initContainers"):
        for c in pod.get(kind, []):
            if isinstance(c, dict):
                flag = (c.get("securityContext") or {}).get("privileged")
                yield "container", str(c.get("name", "?")), None, None, flag is True


def facts_of(kind, content, loader):
    """Facts of one file.  A file the parser rejects has none; a document of an
    unexpected shape yields one 'error' fact and spares the others."""
    import yaml

    try:
        if kind == "cloudformation":
            docs = [yaml.load(content, Loader=loader)]
        else:
            docs = list(yaml.load_all(content, Loader=loader))
    except Exception:
        return []
    found = []
    for doc in docs:
        if not isinstance(doc, dict):
            continue
        if kind == "cloudformation" and "Resources" not in doc:
            continue
        try:
            found += list(_ingress(doc) if kind == "cloudformation" else _containers(doc))
        except (AttributeError, TypeError):
            found.append(("error", "yaml-shape", None, None, None))
    return found


def make_facts(tolerant: bool = False):
    """(kinds, contents) -> lists of facts, over Arrow batches; null in, empty out.

    Tags such as !Ref make the safe loader reject the file.  ``tolerant`` reads
    them as plain values.
    """

    def batch(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        import yaml

        class Loader(yaml.SafeLoader):
            pass

        if tolerant:
            Loader.add_multi_constructor("!", lambda ld, suffix, node: str(node.value))
        keys = ["kind", "name", "port", "cidr", "privileged"]
        return pd.Series(
            [
                []
                if content is None
                else [dict(zip(keys, f)) for f in facts_of(kind, content, Loader)]
                for kind, content in zip(kinds, contents)
            ],
            dtype=object,
        )

    return batch
