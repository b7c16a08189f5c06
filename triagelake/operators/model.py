"""Questions to a model about each row, with a checked form of answer, bounded repair, a budget of calls and replay.

The model never decides a tier. A backend is any picklable object with chat(messages, model) -> text; messages are
(role, text) pairs. Rows are asked where they are (mapInPandas, one Arrow batch at a time). The budget is dealt to partitions
before the job starts, so its ceiling holds without shared state; a task that is run again after a lost executor asks again.

Every row gives one decision. status: completed, unresolved_parse (no valid object), unresolved_semantic (an object without a
conclusion, or a confidence out of range), unresolved_budget, unresolved_replay_missing, unresolved_backend (it raised).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DECISION = "request_id string, subject string, task_type string, role string, model string, status string, attempts int, decision string, errors array<string>"
DISPOSITIONS = ("confirmed", "unconfirmed", "false_positive", "mitigated", "accepted_risk", "remediated")
# Fixed values.
OPENING, CLOSING = "UNTRUSTED_EVIDENCE_JSON\n", "\nEND_UNTRUSTED_EVIDENCE_JSON"
RATIONALE = ("rationale", "reasoning", "conclusion")
LONGEST_REPLY = 4000


class Backend(Protocol):
    def chat(self, messages: list[tuple[str, str]], model: str) -> str: ...


@dataclass
class Mock:
    """The same answer to everything."""

    answer: str = '{"conclusion":"evidence insufficient","confidence":0.5,"rationale":"mock"}'

    def chat(self, messages: list[tuple[str, str]], model: str) -> str:
        return self.answer


@dataclass(frozen=True)
class Form:
    """What an answer must look like: names of text, list and number fields, and the words one may take."""

    required: tuple[str, ...] = ()
    text: dict[str, str] = field(default_factory=dict)
    lists: tuple[str, ...] = ()
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)
    confidence: float | None = None
    clamped: bool = False

    def schema(self) -> str:
        kinds = {**dict.fromkeys(self.text, "string"), **dict.fromkeys(self.lists, "list of strings"), **{k: list(v) for k, v in self.choices.items()}}
        if self.confidence is not None:
            kinds["confidence"] = "number from 0 to 1"
        return json.dumps({"fields": kinds, "required": list(self.required)}, sort_keys=True, separators=(",", ":"))

    def read(self, data: dict[str, Any]) -> dict[str, Any]:
        """The answer's own fields with defaults; ValueError if one is of the wrong kind."""
        out: dict[str, Any] = {}
        for name in self.required:
            if name not in data:
                raise ValueError(f"{name} is missing")
        for name, default in self.text.items():
            out[name] = data.get(name, default)
            if not isinstance(out[name], str):
                raise ValueError(f"{name} is no text")
        for name in self.lists:
            out[name] = data.get(name, [])
            if not isinstance(out[name], list) or not all(isinstance(x, str) for x in out[name]):
                raise ValueError(f"{name} is no list of texts")
        for name, words in self.choices.items():
            out[name] = data.get(name, words[0])
            if out[name] not in words:
                raise ValueError(f"{name} is none of {', '.join(words)}")
        if self.confidence is not None:
            out["confidence"] = self._confidence(data.get("confidence", self.confidence))
        return out

    def _confidence(self, value: Any) -> float:
        try:
            number = float(value)
        except (TypeError, ValueError):
            if self.clamped:
                return 0.5
            raise ValueError("confidence is not numeric") from None
        return min(1.0, max(0.0, number)) if self.clamped and number == number else number


OBSERVATION = Form(("role", "conclusion"), {"role": "", "conclusion": ""}, ("evidence_refs", "conflicts", "missing_evidence"), {}, 0.5, True)
CHALLENGE = Form((), {"rationale": ""}, ("conflicts", "missing_evidence"), {"disposition": DISPOSITIONS})
ANSWER = Form((), {"conclusion": "evidence insufficient", "rationale": ""}, (), {}, 0.5)


def parse(text: str | None) -> dict[str, Any]:
    """The one JSON object that a reply is, bare or in one fence; empty for anything else."""
    body = (text or "").strip()
    if body.startswith("```"):
        head, _, rest = body.partition("\n")
        inner, fence, after = rest.rpartition("\n")
        if head[3:].strip().lower() not in ("", "json") or (fence + after).strip() != "```":
            return {}
        body = inner
    try:
        value = json.loads(body)
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def unsound(data: dict[str, Any]) -> list[str]:
    """What is wrong with the meaning of a well-formed answer."""
    out = []
    if "confidence" in data and not 0 <= data["confidence"] <= 1:
        out.append("confidence must be between 0 and 1")
    if not any(str(data.get(k) or "").strip() for k in RATIONALE):
        out.append("structured observation requires a rationale or conclusion")
    return out


def identity(messages: list[tuple[str, str]], model: str, context: dict[str, Any]) -> str:
    """The SHA-256 of all that a request is made of."""
    about = {k: context.get(k) for k in ("run_id", "finding_id", "role")} | {"task_type": context.get("task_type", "structured"), "iteration": context.get("iteration", 0), "model": model}
    text = json.dumps(about | {"messages": [{"role": r, "content": t} for r, t in messages]}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Budget:
    """Calls reserved before they are made. None: no limit. One task's share; not shared between processes."""

    limit: int | None = None
    used: int = 0

    def take(self, n: int = 1) -> bool:
        if not isinstance(n, int) or isinstance(n, bool) or n < 1:
            raise ValueError("calls to reserve must be a positive integer")
        if self.limit is not None and self.used + n > self.limit:
            return False
        self.used += n
        return True

    @property
    def exhausted(self) -> bool:
        return self.limit is not None and self.used >= self.limit


def share(limit: int | None, part: int, parts: int) -> int | None:
    """A partition's part of the budget; the parts add up to it."""
    return None if limit is None else limit // parts + (part < limit % parts)


def converged(iteration: int, most: int, unresolved: int, exhausted: bool) -> tuple[bool, str]:
    """Whether to stop asking, and why."""
    if iteration >= most:
        return True, "max_iterations"
    if exhausted:
        return True, "analysis_budget_exhausted"
    return (True, "no_unresolved_analysis") if unresolved == 0 else (False, "unresolved_analysis_remains")


def instructed(prompt: str, form: Form) -> list[tuple[str, str]]:
    rule = "Return exactly one JSON object with no prose or markdown. It must have this form and use only supplied evidence. If evidence is insufficient, express uncertainty. FORM="
    return [("user", prompt), ("user", rule + form.schema())]


def ask(backend: Backend, messages: list[tuple[str, str]], form: Form, model: str, budget: Budget, repairs: int = 1) -> tuple[str, int, dict | None, list[str]]:
    """status, calls, answer and errors of one request; a reply of the wrong form is sent back up to `repairs` times."""
    errors: list[str] = []
    status, now = "unresolved_parse", messages
    for call in range(max(0, repairs) + 1):
        if not budget.take():
            return "unresolved_budget", call, None, [*errors, "model-call budget exhausted"]
        try:
            reply = backend.chat(now, model)
        except Exception as e:  # noqa: BLE001 - whatever a backend raises is that row's result
            return "unresolved_backend", call + 1, None, [*errors, f"{type(e).__name__}: {e}"]
        data = parse(reply)
        try:
            if not data:
                raise ValueError("no JSON object found in response")
            answer = form.read(data)
        except ValueError as e:
            status, found = "unresolved_parse", [str(e)]
        else:
            found = unsound(answer)
            if not found:
                return "completed", call + 1, answer, errors
            status = "unresolved_semantic"
        errors += found
        now = [*messages, ("assistant", reply[:LONGEST_REPLY]), ("user", f"Validation failed: {'; '.join(found)}. Return only the JSON object.")]
    return status, max(0, repairs) + 1, None, errors


def prompt(evidence: dict[str, Column]) -> Column:
    """Evidence as JSON between markers that say it is not to be trusted."""
    body = F.to_json(F.struct(*[c.alias(name) for name, c in sorted(evidence.items())]), {"ignoreNullFields": "false"})
    return F.concat(F.lit(OPENING), body, F.lit(CLOSING))


def decide(df: DataFrame, backend: Backend, form: Form, model: str = "offline", limit: int | None = None, repairs: int = 1, context: dict[str, Any] | None = None) -> DataFrame:
    """One decision (DECISION) for each row of df, which has subject and prompt. limit: most calls over the whole table.

    Null prompts count as empty; null subjects are kept. Rows that repeat are asked anew.
    """
    df, about = df.select("subject", "prompt"), dict(context or {})
    if limit is not None:
        # the partitions that share the budget must be known before the job starts
        parts = df.sparkSession.sparkContext.defaultParallelism
        df = df.repartition(parts)
    else:
        parts = 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        budget = Budget(share(limit, task.partitionId() if task else 0, parts))
        for f in frames:
            rows = []
            for subject, text in zip(f["subject"], f["prompt"], strict=True):
                messages = instructed(text or "", form)
                status, calls, answer, errors = ask(backend, messages, form, model, budget, repairs)
                name = identity(messages, model, about | {"finding_id": subject})
                rows.append((name, subject, about.get("task_type", "structured"), about.get("role"), model, status, calls, None if answer is None else json.dumps(answer, sort_keys=True), errors))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DECISION.split(", ")])

    return df.mapInPandas(run, DECISION)


def replayed(df: DataFrame, decisions: DataFrame, form: Form, model: str = "offline", context: dict[str, Any] | None = None) -> DataFrame:
    """The decisions that were recorded for the same requests, checked again; nothing is asked."""
    about = dict(context or {})

    def named(f: pd.DataFrame) -> list[str]:
        return [identity(instructed(t or "", form), model, about | {"finding_id": s}) for s, t in zip(f["subject"], f["prompt"], strict=True)]

    def requests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"request_id": named(f), "subject": f["subject"]})

    @F.pandas_udf(StringType())
    def state(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "unresolved_replay_missing" if t is None else checked(t, form))

    known = decisions.filter("decision IS NOT NULL").groupBy("request_id").agg(F.min("decision").alias("recorded"))
    out = df.select("subject", "prompt").mapInPandas(requests, "request_id string, subject string").join(known, "request_id", "left").withColumn("status", state(F.col("recorded")))
    return out.select("request_id", "subject", "status", F.when(F.col("status") == "completed", F.col("recorded")).alias("decision"))


def checked(text: str, form: Form) -> str:
    """The status that a recorded answer has today."""
    try:
        return "unresolved_semantic" if unsound(form.read(parse(text))) else "completed"
    except ValueError:
        return "unresolved_parse"
