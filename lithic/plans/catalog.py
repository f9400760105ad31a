"""The operation catalog: typed operations over the gate, and composites of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lithic.operators import facts as ops
from lithic.operators.gate import Gate, Param, coerced
from lithic.operators.retrieval import retrieve_evidence


class UnknownOperation(LookupError):
    """Also raised for an operation out of the principal's scope: what may not be used looks absent."""


@dataclass(frozen=True)
class Operation:
    name: str
    run: Callable[..., DataFrame]
    params: dict[str, Param]
    roles: tuple[str, ...] = ()
    returns: str = "facts"


@dataclass(frozen=True)
class Step:
    """One call of a composite. A binding is a constant, `param:name`, or `step:name:column` (the first row's value). A step is skipped if what it
    takes from an earlier one is null; a parameter that isn't given is passed on as not given."""

    name: str
    operation: str
    bind: dict[str, object]
    fallback: str | None = None


@dataclass(frozen=True)
class Composite:
    name: str
    steps: tuple[Step, ...]
    params: dict[str, Param]
    roles: tuple[str, ...] = ()


@dataclass(frozen=True)
class Trace:
    """What a step did: ok, fallback or skipped."""

    step: str
    operation: str
    status: str
    bound: dict[str, object]


@dataclass
class Catalog:
    entries: dict[str, Operation | Composite] = field(default_factory=dict)

    def register(self, entry: Operation | Composite) -> None:
        """A name can be registered again only with the same parameters."""
        old = self.entries.get(entry.name)
        if old and set(old.params) != set(entry.params):
            raise ValueError(f"{entry.name} is registered with other parameters")
        if isinstance(entry, Composite):
            self.check_closure(entry, ())
        self.entries[entry.name] = entry

    def check_closure(self, entry: Composite, above: tuple[str, ...]) -> None:
        for s in entry.steps:
            for name in filter(None, (s.operation, s.fallback)):
                if name in (*above, entry.name):
                    raise ValueError(f"{name} calls itself")
                if name not in self.entries:
                    raise UnknownOperation(name)
                if isinstance(self.entries[name], Composite):
                    self.check_closure(self.entries[name], (*above, entry.name))

    def visible(self, gate: Gate) -> list[str]:
        return sorted(n for n, e in self.entries.items() if not e.roles or set(e.roles) & set(gate.principal.roles))

    def execute(self, gate: Gate, name: str, trace: list[Trace] | None = None, **params: object) -> DataFrame | dict[str, DataFrame]:
        if name not in self.visible(gate):
            raise UnknownOperation(name)
        entry = self.entries[name]
        if unknown := set(params) - set(entry.params):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        values = {k: coerced(k, p, params.get(k)) for k, p in entry.params.items()}
        if isinstance(entry, Operation):
            return entry.run(gate, **values)
        return self.composed(gate, entry, values, [] if trace is None else trace)

    def traced(self, gate: Gate, name: str, **params: object) -> tuple[dict[str, DataFrame], list[Trace]]:
        """A composite's results with what each step did, those of nested composites dotted and before the step that calls them."""
        trace: list[Trace] = []
        return self.execute(gate, name, trace=trace, **params), trace

    def composed(self, gate: Gate, entry: Composite, values: dict[str, object], trace: list[Trace]) -> dict[str, DataFrame]:
        """Results by step, dotted for steps of nested composites. Only first rows' bound values cross to the driver."""
        results: dict[str, DataFrame] = {}
        for s in entry.steps:
            bound = {k: self.bound(v, values, results) for k, v in s.bind.items()}
            if any(v is None and str(s.bind[k]).startswith("step:") for k, v in bound.items()):
                trace.append(Trace(s.name, s.operation, "skipped", bound))
                continue
            inner: list[Trace] = []
            got, status, ran = self.execute(gate, s.operation, trace=inner, **bound), "ok", s.operation
            if s.fallback and isinstance(got, DataFrame) and got.isEmpty():
                got, status, ran = self.execute(gate, s.fallback, trace=inner, **bound), "fallback", s.fallback
            trace += [Trace(f"{s.name}.{t.step}", t.operation, t.status, t.bound) for t in inner]
            trace.append(Trace(s.name, ran, status, bound))
            if isinstance(got, dict):
                results |= {f"{s.name}.{k}": v for k, v in got.items()}
            else:
                results[s.name] = got
        return results

    @staticmethod
    def bound(binding: object, values: dict[str, object], results: dict[str, DataFrame]) -> object:
        if isinstance(binding, str) and binding.startswith("param:"):
            return values[binding[6:]]
        if isinstance(binding, str) and binding.startswith("step:"):
            _, step, column = binding.split(":")
            rows = results[step].orderBy(column).select(column).head(1) if step in results else []
            return rows[0][0] if rows else None
        return binding


def base_catalog() -> Catalog:
    role = Param("string", choices=("subject", "object", "any"), default="any")
    c = Catalog()
    c.register(Operation("get_facts", ops.get_facts, {"entity_id": Param("long", True), "predicate": Param("string"), "role": role}))
    c.register(Operation("get_by_key", ops.get_by_key, {"identifier": Param("string", True), "key": Param("string"), "role": Param("string", choices=("subject", "object", "any"), default="subject")}))
    c.register(Operation("get_entity", ops.get_entity, {"entity_id": Param("long"), "identifier": Param("string"), "key": Param("string")}, returns="entities"))
    c.register(Operation("neighbors", ops.neighbors, {"entity_id": Param("long", True), "predicate": Param("string"), "depth": Param("long", least=1, most=5, default=1)}))
    c.register(Operation("facts_citing", ops.facts_citing, {"document_id": Param("long"), "chunk_id": Param("long")}))
    c.register(Operation("passage", ops.passage, {"chunk_id": Param("long", True)}, returns="evidence"))
    search = {"query": Param("embedding_text", True), "k": Param("long", least=1, most=50, default=10), "mode": Param("string", choices=("dense", "hybrid"), default="dense")}
    c.register(Operation("retrieve", retrieve_evidence, search, returns="evidence"))
    dossier = (
        Step("resolve", "get_by_key", {"identifier": "param:identifier", "key": "param:key", "role": "subject"}),
        Step("facts", "get_facts", {"entity_id": "step:resolve:subject_id", "role": "any"}),
        Step("evidence", "retrieve", {"query": "step:resolve:subject_name"}),
    )
    c.register(Composite("entity_dossier", dossier, {"identifier": Param("string", True), "key": Param("string")}))
    return c
