"""Response rules per explorer and endpoint, compiled to columns.

A rule document (``rules/<explorer>_<endpoint>.json``) describes an answer:

* ``kind``: ``text``, ``list`` or ``object``;
* text: ``one_of`` (allowed values), ``like`` (a name in ``PATTERNS``,
  whose ``$`` is the very end: no line break may follow),
  ``at_least`` / ``at_most`` (length);
* list: ``at_most`` (items), ``each`` (the rule of every item);
* object: ``needs`` (fields that must be there), ``fields`` (a rule per
  field, checked where the field is there), ``closed`` (no other fields);
* ``either``: alternatives of different kinds.

``compile_rule`` turns a document into one column expression over the parsed
answer (VARIANT): no join, no shuffle, no Python in the tasks. The result is an array of
``"<path> <problem>"`` such as ``result[3].hash does not match pattern``; values
of the answer are never part of a message.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from tokenflow.functions import scalar as S

RULES = Path(__file__).with_name("rules")
ROOT = "answer"
# fixed values: formats of response fields
PATTERNS = {
    "digits": r"^[0-9]+$",
    "hash": r"^0x[a-fA-F0-9]{64}$",
    "address": r"^0x[a-fA-F0-9]{40}$",
    "hex": r"^0x[a-fA-F0-9]*$",
    "holder_notice": r"^(No token holder found|Error: .*)$",
}
KINDS = {"text": "text", "list": "a list", "object": "an object"}
OPTIONS = {"text": {"one_of", "like", "at_least", "at_most"}, "list": {"at_most", "each"},
           "object": {"needs", "fields", "closed"}}


@lru_cache(maxsize=8)
def documents(folder: str = str(RULES)) -> dict[tuple[str, str], dict]:
    """(explorer, endpoint) -> rule document, all files of a folder."""
    found = {}
    for path in sorted(Path(folder).glob("*.json")):
        doc = json.loads(path.read_text())
        check_document(doc.get("answer"), path.name)
        key = (doc["explorer"].lower(), doc["endpoint"].lower())
        if key in found:
            raise ValueError(f"{path.name}: a second document for {key}")
        found[key] = doc
    return found


def check_document(rule, at: str) -> None:
    """Raise on anything in a rule that the compiler does not know."""
    if not isinstance(rule, dict):
        raise ValueError(f"{at}: a rule is an object")
    if "either" in rule:
        kinds = [r.get("kind") for r in rule["either"]]
        if set(rule) != {"either"} or len(set(kinds)) != len(kinds):
            raise ValueError(f"{at}: alternatives must be of different kinds")
        for r in rule["either"]:
            check_document(r, at)
        return
    kind = rule.get("kind")
    if kind not in KINDS or set(rule) - {"kind"} - OPTIONS[kind]:
        raise ValueError(f"{at}: unknown kind or option in {sorted(rule)}")
    if rule.get("like", "digits") not in PATTERNS:
        raise ValueError(f"{at}: unknown pattern {rule['like']!r}")
    for name, r in rule.get("fields", {}).items():
        check_document(r, f"{at}.{name}")
    if "each" in rule:
        check_document(rule["each"], f"{at}[]")


# ------------------------------------------------------------------ compiler

#: what a value of a kind reads as; null: it is of another kind
READ = {"text": "string", "list": "array<variant>", "object": "map<string,variant>"}


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _read(v: Column, kind: str) -> Column:
    read = F.try_variant_get(v, "$", READ[kind])
    return F.when(F.schema_of_variant(v) == "STRING", read) if kind == "text" else read  # a number reads as text, too


def _case(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    return F.coalesce(*[F.when(c, x) for c, x in pairs], otherwise)


def _say(path, text: str) -> Column:
    return F.concat(path if isinstance(path, Column) else F.lit(path), F.lit(f" {text}"))


def _inside(path, name: str):
    if isinstance(path, Column):
        return F.concat(path, F.lit(f".{name}"))
    return name if path == ROOT else f"{path}.{name}"


NONE = "array<string>"


def _flag(wrong: Column, message: Column) -> Column:
    return F.when(wrong, F.array(message)).otherwise(F.array().cast(NONE))


def _problems(x: Column, path, rule: dict) -> Column:
    """array<string> of the problems of a value of the right kind, as ``_read`` gives it."""
    kind = rule["kind"]
    parts = []
    if kind == "text":
        if "one_of" in rule:
            parts.append(_flag(~x.isin(rule["one_of"]), _say(path, "is not an allowed value")))
        if "at_least" in rule:
            parts.append(_flag(F.length(x) < rule["at_least"], _say(path, "is too short")))
        if "at_most" in rule:
            parts.append(_flag(F.length(x) > rule["at_most"], _say(path, "is too long")))
        if "like" in rule:
            parts.append(_flag(~x.rlike(re.sub(r"\$$", r"\\z", PATTERNS[rule["like"]])), _say(path, "does not match pattern")))
    elif kind == "list":
        if "at_most" in rule:
            parts.append(_flag(F.size(x) > rule["at_most"], _say(path, "has too many items")))
        if "each" in rule:
            at = path if isinstance(path, Column) else F.lit(path)
            parts.append(F.flatten(F.transform(x, lambda item, i: _checked(
                item, F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), rule["each"]))))
    else:
        for name in dict.fromkeys([*rule.get("needs", ()), *rule.get("fields", {})]):
            own = _inside(path, name)
            lacks = F.array(_say(own, "is required")) if name in rule.get("needs", ()) else F.array().cast(NONE)
            checked = (lambda f: _checked(f, own, rule["fields"][name])) if name in rule.get("fields", {}) else (
                lambda f: F.array().cast(NONE))
            # null: the field is not there
            parts.append(_let(F.try_element_at(x, F.lit(name)), lambda f: F.when(f.isNull(), lacks).otherwise(checked(f))))
        if rule.get("closed"):
            known = F.array(*[F.lit(n) for n in rule.get("fields", {})]) if rule.get("fields") else F.array().cast(NONE)
            at = F.lit("") if path == ROOT else F.concat(path if isinstance(path, Column) else F.lit(path), F.lit("."))
            parts.append(F.transform(F.array_except(F.map_keys(x), known), lambda k: F.concat(at, k, F.lit(" is not expected"))))
    if not parts:
        return F.array().cast(NONE)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _checked(v: Column, path, rule: dict) -> Column:
    """array<string> of the problems of a value that is there."""
    found = F.array(_say(path, "matches no allowed form" if "either" in rule else f"is not {KINDS[rule['kind']]}"))
    for r in reversed(rule.get("either", [rule])):
        found = _let(_read(v, r["kind"]), lambda x: F.when(x.isNotNull(), _problems(x, path, r)).otherwise(found))
    return found


def compile_rule(doc: dict, body) -> Column:
    """array<string>: the problems of the answer text ``body`` under a document."""
    return _let(F.try_parse_json(S.col(body)), lambda v: F.when(v.isNull(), F.array(F.lit(f"{ROOT} is not JSON"))).otherwise(
        _checked(v, ROOT, doc["answer"])))


# ------------------------------------------------------------------ operator

def answer_text(status="status", message="message", result="result") -> Column:
    """Answer text of a landed page whose ``result`` is kept as text: a JSON list, or a notice."""
    r = S.col(result)
    quoted = F.regexp_replace(F.to_json(F.array(r)), r"^\[|\]$", "")
    parts = [F.concat(F.lit(f'"{n}":'), F.regexp_replace(F.to_json(F.array(S.col(c))), r"^\[|\]$", ""))
             for n, c in (("status", status), ("message", message))]
    given = [F.when(S.col(c).isNotNull(), p) for c, p in zip((status, message), parts)]
    given.append(F.when(r.isNotNull(), F.concat(F.lit('"result":'), F.when(r.startswith("["), r).otherwise(quoted))))
    return F.concat(F.lit("{"), F.concat_ws(",", *given), F.lit("}"))


def check_responses(pages: DataFrame, body="body", explorer: str = "source_explorer", endpoint: str = "endpoint",
                    policy: str = "fail-closed", folder: str = str(RULES), max_depth: int | None = 10) -> DataFrame:
    """V12 with V13 and V14: ``pages`` plus ``schema_errors``, ``schema_ok`` and ``schema_version``.

    The document of each row's (explorer, endpoint) decides; names are compared
    without case. An answer nested deeper than ``max_depth`` has that one error. Rows
    without a document go by ``policy``: ``fail-closed`` rejects them, ``skip``
    accepts them, ``permissive`` asks for an object with ``status`` and ``result`` only.
    A null answer is not JSON."""
    from tokenflow.sources.pages import nesting_depth
    absent = {
        "fail-closed": F.array(F.lit("no rules for this explorer and endpoint")),
        "skip": F.array().cast(NONE),
        "permissive": compile_rule({"answer": {"kind": "object", "needs": ["status", "result"], "fields": {
            "status": {"kind": "text"}, "message": {"kind": "text"}}}}, body)}
    if policy not in absent:
        raise ValueError(f"unknown policy {policy!r}")
    named = F.concat_ws("/", F.lower(F.col(explorer)), F.lower(F.col(endpoint)))
    known = documents(folder)
    errors = _case([(named == f"{e}/{p}", compile_rule(doc, body)) for (e, p), doc in known.items()], absent[policy])
    version = _case([(named == f"{e}/{p}", F.lit(doc["version"])) for (e, p), doc in known.items()], F.lit(None).cast("string"))
    if max_depth is not None:
        errors = F.when(nesting_depth(S.col(body)) > max_depth, F.array(F.lit(f"{ROOT} is nested too deeply"))).otherwise(errors)
    out = pages.withColumn("schema_errors", errors)
    return out.withColumns({"schema_ok": F.size("schema_errors") == 0, "schema_version": version})
