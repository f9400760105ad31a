"""Row-level security, tenancy and currency as a gate that every served read passes.

A Gate hands out relations already filtered, so an operation can't read an ungated table. Catalyst pushes the filters to
the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC = "public"


@dataclass(frozen=True)
class Principal:
    tenant: str
    name: str = "anonymous"
    roles: tuple[str, ...] = ()


def granted_labels(memberships: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """The labels that roles may see, `public` always: label. An unknown role grants nothing."""
    granted = memberships.filter(F.col("role").isin(*roles)).select("label") if roles else memberships.select("label").limit(0)
    return granted.unionByName(memberships.sparkSession.sql(f"SELECT '{PUBLIC}' AS label")).distinct()


def tenant_rows(df: DataFrame, tenant: str) -> DataFrame:
    return df.filter(F.col("tenant_id") == tenant)


def secured_rows(df: DataFrame, tenant: str, labels: list[str]) -> DataFrame:
    """Rows of a tenant without a label or with a granted one."""
    return tenant_rows(df, tenant).filter(F.col("label").isNull() | F.col("label").isin(labels))


def current_rows(df: DataFrame, include_retracted: bool = False) -> DataFrame:
    return df if include_retracted else df.filter(F.col("valid_to").isNull())


@dataclass
class Gate:
    """The relations as one principal may see them. Labels are a role table's distinct values, of a size fixed by policy."""

    principal: Principal
    memberships: DataFrame
    relations: dict[str, DataFrame]
    include_retracted: bool = False
    labels: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.labels = [r.label for r in granted_labels(self.memberships, self.principal.roles).collect()]

    def read(self, name: str) -> DataFrame:
        df = self.relations[name]
        if "label" in df.columns:
            df = secured_rows(df, self.principal.tenant, self.labels)
        elif "tenant_id" in df.columns:
            df = tenant_rows(df, self.principal.tenant)
        return current_rows(df, self.include_retracted) if "valid_to" in df.columns else df


def optional(value: object, condition: Column) -> Column:
    """A condition that holds for every row if its parameter isn't given."""
    return F.lit(True) if value is None else condition


class TemplateError(ValueError):
    pass


RESERVED = {"tenant", "labels", "roles", "include_retracted"}
GATED, CURRENT = {"facts", "entities", "documents", "chunks"}, {"facts", "documents"}


def check_template(sql: str, params: set[str]) -> None:
    """A template is one SELECT, every gated table's alias has a {sec:} marker and every alias of a table with validity a {cur:} marker."""
    text = re.sub(r"'(?:[^']|'')*'", "''", sql).strip()
    if ";" in text.rstrip(";") or not re.match(r"(?i)(select|with)\b", text):
        raise TemplateError("one SELECT statement is allowed")
    marks = {kind: set(re.findall(rf"\{{{kind}:(\w+)\}}", text)) for kind in ("sec", "cur", "tenant")}
    if not marks["sec"]:
        raise TemplateError("a {sec:alias} marker is needed")
    for name, alias in re.findall(r"(?i)\b(?:from|join)\s+(\w+)\s+(?:as\s+)?(\w+)", text):
        if name in GATED and alias not in marks["sec"]:
            raise TemplateError(f"{alias} lacks {{sec:{alias}}}")
        if name in CURRENT and alias not in marks["cur"]:
            raise TemplateError(f"{alias} lacks {{cur:{alias}}}")
    if params & RESERVED:
        raise TemplateError(f"reserved parameters: {sorted(params & RESERVED)}")


def gated_sql(sql: str, gate: Gate, params: dict[str, object]) -> DataFrame:
    """Run a checked template over the raw relations, with the markers expanded to the gate's conditions."""
    check_template(sql, set(params))
    text = re.sub(r"\{sec:(\w+)\}", r"(\1.tenant_id = :tenant AND (\1.label IS NULL OR array_contains(:labels, \1.label)))", sql)
    text = re.sub(r"\{tenant:(\w+)\}", r"(\1.tenant_id = :tenant)", text)
    text = re.sub(r"\{cur:(\w+)\}", r"TRUE" if gate.include_retracted else r"(\1.valid_to IS NULL)", text)
    used = {n: df for n, df in gate.relations.items() if re.search(rf"(?i)\b(?:from|join)\s+{n}\b", text)}
    text = re.sub(r"(?i)\b(from|join)\s+(" + "|".join(used) + r")\b", r"\1 {\2}", text)
    spark = gate.memberships.sparkSession
    return spark.sql(text, args={"tenant": gate.principal.tenant, "labels": F.array(*map(F.lit, gate.labels)), **params}, **used)


@dataclass(frozen=True)
class Param:
    """A typed parameter of an operation."""

    kind: str  # string, long, double, boolean, timestamp, list or embedding_text
    required: bool = False
    choices: tuple[object, ...] = ()
    least: float | None = None
    most: float | None = None
    default: object = None


_KINDS = {"string": str, "long": int, "double": float, "boolean": bool, "timestamp": str, "list": list, "embedding_text": str}


def coerced(name: str, param: Param, value: object) -> object:
    """A parameter's value in its type, or an error: what isn't certainly right is refused."""
    if value is None:
        if param.required and param.default is None:
            raise ValueError(f"{name} is needed")
        return param.default
    kind = _KINDS[param.kind]
    if kind in (int, float) and isinstance(value, str):
        value = kind(value)
    if kind is bool and value in ("true", "false"):
        value = value == "true"
    if kind is float and type(value) is int:
        value = float(value)
    if type(value) is not kind:
        raise ValueError(f"{name} must be {param.kind}")
    if param.choices and value not in param.choices:
        raise ValueError(f"{name} must be one of {param.choices}")
    if param.least is not None and value < param.least or param.most is not None and value > param.most:
        raise ValueError(f"{name} is out of range")
    return value
