"""Plans: small DAGs of named operators, validated, bound, and lowered to one lazy DataFrame a step."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import SearchError

MAX_STEPS, WRITE_CONFIDENCE = 12, 0.75
_REF = re.compile(r"\{\{\s*([a-z][\w]*)\.(\w+)((?:\[\*\]|\[\d+\]|\.\w+)*)(?:\s*\|\s*([\w+-]+)(?:\(([^)]*)\))?)?\s*\}\}")


class PlanError(ValueError):
    """All faults that validation found, each with the step that it concerns."""

    def __init__(self, faults: list[str]) -> None:
        super().__init__("; ".join(faults))
        self.faults = faults


@dataclass(frozen=True)
class Op:
    """An operator: its arguments with types, the columns that it gives, and the function that lowers it."""

    name: str
    args: Mapping[str, type | tuple[type, ...]]
    fields: tuple[str, ...]
    lower: Callable[..., DataFrame]
    required: tuple[str, ...] = ()
    is_write: bool = False

    @property
    def service(self) -> str:
        return self.name.split(".")[0]


@dataclass
class Step:
    id: str
    op: str
    args: dict[str, Any] = field(default_factory=dict)
    depends_on: list[str] = field(default_factory=list)
    optional: bool = False
    gate: dict[str, Any] | None = None


@dataclass
class Plan:
    steps: list[Step]
    services: list[str] = field(default_factory=list)
    has_write: bool = False
    confidence: float = 1.0

    @staticmethod
    def of(spec: Mapping[str, Any]) -> Plan:
        intent = spec.get("intent", {})
        return Plan([Step(**{k: v for k, v in s.items() if k in Step.__dataclass_fields__}) for s in spec["steps"]], list(intent.get("services", [])), bool(intent.get("has_write")), float(intent.get("confidence", 1.0)))


def references(value: Any) -> list[re.Match]:
    if isinstance(value, str):
        return list(_REF.finditer(value))
    if isinstance(value, Mapping):
        value = value.values()
    return [m for x in value for m in references(x)] if isinstance(value, (list, tuple)) or hasattr(value, "__iter__") and not isinstance(value, (str, bytes)) else []


def order(plan: Plan) -> list[str]:
    """Step ids so that each follows what it depends on; a cycle is an error."""
    needs = {s.id: set(s.depends_on) for s in plan.steps}
    out: list[str] = []
    while needs:
        free = sorted(k for k, v in needs.items() if not v & needs.keys())
        if not free:
            raise PlanError([f"the steps {sorted(needs)} wait for each other"])
        out += free
        for k in free:
            del needs[k]
    return out


def upstream(plan: Plan, step: str) -> set[str]:
    needs = {s.id: s.depends_on for s in plan.steps}
    seen: set[str] = set()
    todo = list(needs.get(step, []))
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += needs.get(x, [])
    return seen


def validate(plan: Plan, ops: Mapping[str, Op]) -> Plan:
    """The plan with plural field names mended, or a ``PlanError`` with every fault."""
    faults: list[str] = []
    ids = [s.id for s in plan.steps]
    if not ids:
        faults.append("a plan needs a step")
    if len(ids) > MAX_STEPS:
        faults.append(f"{len(ids)} steps are more than {MAX_STEPS}")
    faults += [f"{x}: the id is used twice" for x in {x for x in ids if ids.count(x) > 1}]
    by_id = {s.id: s for s in plan.steps}
    for s in plan.steps:
        faults += [f"{s.id}: depends on {x}, which is no step" for x in s.depends_on if x not in by_id]
    try:
        order(plan)
    except PlanError as e:
        faults += e.faults
    for s in plan.steps:
        if (op := ops.get(s.op)) is None:
            faults.append(f"{s.id}: no operator {s.op!r}")
            continue
        if plan.services and op.service not in (*plan.services, "data", "search"):
            faults.append(f"{s.id}: {op.service} is not among the intent's services")
        if op.is_write and not plan.has_write:
            faults.append(f"{s.id}: a write under an intent to read")
        if op.is_write and plan.confidence < WRITE_CONFIDENCE:
            faults.append(f"{s.id}: a write needs a confidence of {WRITE_CONFIDENCE}")
        faults += [f"{s.id}: {a!r} is no argument of {s.op}" for a in s.args if a not in op.args]
        faults += [f"{s.id}: {a!r} is missing" for a in op.required if a not in s.args]
        for a, v in s.args.items():
            if a in op.args and not references(v) and not isinstance(v, op.args[a]):
                faults.append(f"{s.id}: {a!r} is of the wrong type")
        above = upstream(plan, s.id)
        for m in references(list(s.args.values()) + ([s.gate] if s.gate else [])):
            source, name = m[1], m[2]
            if source not in above:
                faults.append(f"{s.id}: refers to {source}, which is not upstream")
            elif (other := ops.get(by_id[source].op)) and name not in other.fields:
                mended = next((f for f in (name + "s", name.removesuffix("s"), "refs" if name == "ref" else name) if f in other.fields), None)
                if mended is None:
                    faults.append(f"{s.id}: {source} has no field {name!r}")
                else:
                    s.args = _renamed(s.args, m[0], m[0].replace(f"{source}.{name}", f"{source}.{mended}", 1))
    if faults:
        raise PlanError(faults)
    return plan


def _renamed(value: Any, old: str, new: str) -> Any:
    if isinstance(value, str):
        return value.replace(old, new)
    if isinstance(value, dict):
        return {k: _renamed(v, old, new) for k, v in value.items()}
    return [_renamed(v, old, new) for v in value] if isinstance(value, list) else value


@dataclass(frozen=True)
class Refs:
    """A column of an earlier step: as an argument it becomes a semi join, never a collected list."""

    frame: DataFrame
    column: str

    def filter(self, df: DataFrame, on: str) -> DataFrame:
        keys = self.frame.select(F.col(self.column).alias(on)).where(F.col(on).isNotNull())
        return df.join(keys, on, "left_semi")


def bind(value: Any, done: Mapping[str, DataFrame]) -> Any:
    """References filled in: ``[*]`` stays a lazy column, anything else is the first row's value, read by an action.

    A reference alone keeps its type; inside a text it is written out. A missing value is an error.
    """
    if isinstance(value, dict):
        return {k: bind(v, done) for k, v in value.items()}
    if isinstance(value, list):
        return [bind(v, done) for v in value]
    if not isinstance(value, str):
        return value
    found = references(value)
    if not found:
        return value
    if len(found) == 1 and found[0][0] == value.strip():
        m = found[0]
        return Refs(done[m[1]], m[2]) if "[*]" in m[3] else _filtered(_scalar(done[m[1]], m), m)
    return _REF.sub(lambda m: str(_filtered(_scalar(done[m[1]], m), m)), value)


def _scalar(df: DataFrame, m: re.Match) -> Any:
    index = int(i[1]) if (i := re.search(r"\[(\d+)\]", m[3])) else 0
    rows = df.select(m[2]).limit(index + 1).collect()  # one value of a plan, not data
    if len(rows) <= index or rows[index][0] is None:
        raise PlanError([f"{m[0]} has no value"])
    return rows[index][0]


def _filtered(value: Any, m: re.Match) -> Any:
    from datetime import timedelta

    name, arg = m[4], m[5]
    if not name:
        return value
    if shift := re.fullmatch(r"([+-]\d+)([dhms])", name):
        unit = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}[shift[2]]
        return value + timedelta(**{unit: int(shift[1])})
    if name == "iso":
        return value.isoformat()
    if name == "date":
        return value.date().isoformat()
    if name == "day_start":
        return value.replace(hour=0, minute=0, second=0, microsecond=0)
    if name == "day_end":
        return value.replace(hour=0, minute=0, second=0, microsecond=0) + timedelta(days=1)
    if name == "join":
        return (arg or ", ").join(map(str, value))
    if name in ("first", "last"):
        return value[0 if name == "first" else -1]
    if name == "count":
        return len(value)
    raise PlanError([f"no filter {name!r}"])


def open_gate(gate: Mapping[str, Any], done: Mapping[str, DataFrame]) -> bool:
    """Whether a step may run: a bounded look at the relation that its gate names."""
    df, test, value = done[gate["step"]], gate["test"], gate.get("value")
    if test in ("exists", "not_exists", "empty"):
        return bool(df.take(1)) == (test == "exists")
    if test == "count_gt":
        return len(df.select(F.lit(1)).limit(int(value) + 1).collect()) > int(value)
    rows = df.select(gate["field"]).limit(1).collect()
    if not rows:
        return False
    return {"equals": lambda x: x == value, "contains": lambda x: value in x, "before": lambda x: x < value, "after": lambda x: x > value, "within": lambda x: value[0] <= x < value[1]}[test](rows[0][0])


class Pause(Exception):
    """Raised by an operator that needs an answer first; the plan stops there and can be run again with it."""

    def __init__(self, question: str, choices: tuple[str, ...] = ()) -> None:
        super().__init__(question)
        self.question, self.choices = question, choices


MOST_ROUNDS = 2


def replan(outcome: Mapping[str, str], rounds: int) -> str | None:
    """Why a plan should be made anew: the first fault of its own making, unless that was tried often enough."""
    reason = next((f"{x}: {o}" for x, o in outcome.items() if o.startswith("failed: plan")), None)
    return reason if reason and rounds < MOST_ROUNDS else None


def run(plan: Plan, ops: Mapping[str, Op], completed: Mapping[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results by step, and each step's outcome: ok, skipped (gate or dependency), paused or failed; siblings go on.

    A failure is the plan's (nothing to bind), a service's (the operator failed), or stands at a dependency.
    ``completed`` brings results of an earlier run, whose steps are not run again.
    """
    validate(plan, ops)
    by_id = {s.id: s for s in plan.steps}
    done: dict[str, DataFrame] = dict(completed or {})
    outcome: dict[str, str] = dict.fromkeys(done, "ok")
    for x in order(plan):
        if x in done:
            continue
        s = by_id[x]
        if any(outcome[y] != "ok" and not by_id[y].optional for y in s.depends_on):
            outcome[x] = "skipped: dependency"
        elif s.gate and (s.gate["step"] not in done or not open_gate(s.gate, done)):
            outcome[x] = "skipped: gate"
        else:
            try:
                done[x] = ops[s.op].lower(**bind(s.args, done))
                outcome[x] = "ok"
            except PlanError as e:
                outcome[x] = f"failed: plan: {e}"
            except Pause as e:
                outcome[x] = f"paused: {e.question}"
            except (PySparkException, SearchError) as e:
                outcome[x] = f"failed: service {ops[s.op].service}: {type(e).__name__}"
    return done, outcome
