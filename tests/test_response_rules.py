"""The rule documents and the compiler, against a plain walk over parsed JSON."""

import json
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tokenflow.sources import response_rules as R

GOOD = {"hash": "0x" + "a" * 64, "blockNumber": "5", "timeStamp": "1", "from": "0x" + "1" * 40, "to": "0x" + "2" * 40,
        "value": "1", "contractAddress": "0x" + "3" * 40}


def walk(value, rule, path="answer"):
    """The problems of a parsed value, by recursion."""
    kinds = {"text": str, "list": list, "object": dict}
    if "either" in rule:
        fit = [r for r in rule["either"] if isinstance(value, kinds[r["kind"]])]
        return walk(value, fit[0], path) if fit else [f"{path} matches no allowed form"]
    if not isinstance(value, kinds[rule["kind"]]):
        return [f"{path} is not {R.KINDS[rule['kind']]}"]
    out = []
    if rule["kind"] == "text":
        if "one_of" in rule and value not in rule["one_of"]:
            out.append(f"{path} is not an allowed value")
        if len(value) < rule.get("at_least", 0):
            out.append(f"{path} is too short")
        if len(value) > rule.get("at_most", 10**9):
            out.append(f"{path} is too long")
        if "like" in rule and not re.search(R.PATTERNS[rule["like"]].replace("$", r"\Z"), value):
            out.append(f"{path} does not match pattern")
    elif rule["kind"] == "list":
        if len(value) > rule.get("at_most", 10**9):
            out.append(f"{path} has too many items")
        for i, x in enumerate(value):
            out += walk(x, rule["each"], f"{path}[{i}]")
    else:
        top = "" if path == "answer" else f"{path}."
        for name in {*rule.get("needs", ()), *rule.get("fields", {})}:
            if name in value and name in rule.get("fields", {}):
                out += walk(value[name], rule["fields"][name], top + name)
            elif name not in value and name in rule.get("needs", ()):
                out.append(f"{top}{name} is required")
        if rule.get("closed"):
            out += [f"{top}{k} is not expected" for k in value if k not in rule["fields"]]
    return out


def compare(spark, answers):
    docs = R.documents()
    rows = [(e, p, json.dumps(a)) for a in answers for e, p in docs]
    df = spark.createDataFrame(rows, "source_explorer string, endpoint string, body string")
    for r in R.check_responses(df, max_depth=None).collect():
        want = walk(json.loads(r.body), docs[(r.source_explorer, r.endpoint)]["answer"])
        assert sorted(r.schema_errors) == sorted(want), (r.source_explorer, r.endpoint, r.body[:300])
        assert r.schema_ok == (not want)


def answer(result, **more):
    return {"status": "1", "message": "OK", "result": result, **more}


def test_six_documents_and_their_differences():
    docs = R.documents()
    assert sorted(docs) == [(e, p) for e in ("bscscan", "etherscan", "polygonscan") for p in ("tokenholderlist", "tokentx")]
    fields = {e: docs[(e, "tokentx")]["answer"]["fields"]["result"]["either"][0]["each"]["fields"] for e in ("bscscan", "etherscan", "polygonscan")}
    assert fields["bscscan"]["tokenName"] == {"kind": "text", "at_least": 1} and fields["etherscan"]["tokenName"] == {"kind": "text"}
    assert "like" in fields["etherscan"]["input"] and "like" not in fields["polygonscan"]["input"]
    assert all(len(f) == 19 for f in fields.values())


def test_every_rule_fires_alone(spark):
    fields = R.documents()[("etherscan", "tokentx")]["answer"]["fields"]["result"]["either"][0]["each"]["fields"]
    records = [{k: v for k, v in GOOD.items() if k != f} for f in GOOD]
    records += [{**GOOD, f: bad} for f in fields for bad in ("zz", "", 5, None, [], "12\n")]
    holders = [{"TokenHolderAddress": a, "TokenHolderQuantity": q} for a in ("0x" + "f" * 40, "0x1") for q in ("1", "-1", 1)]
    compare(spark, [answer([r]) for r in records] + [answer(holders), answer([GOOD, 3, "x", {}]), answer([{"new": 1, **GOOD}])])


def test_envelopes(spark):
    compare(spark, [{}, [], "x", 3, None, answer([]), answer("No token holder found"), answer("Error: x"), answer("Error: " + "y" * 494),
                    answer("z"), answer(""), answer(None), answer({}), answer([], more=1, other=[]), {"status": 1, "message": [], "result": []},
                    {"status": "01", "result": "a"}, answer([{}] * 3)])


def test_item_limit_is_exact(spark):
    df = spark.createDataFrame([("polygonscan", "tokenholderlist", json.dumps(answer([{"TokenHolderAddress": "0x" + "f" * 40,
                                "TokenHolderQuantity": "1"}] * n))) for n in (10_000, 10_001)],
                               "source_explorer string, endpoint string, body string")
    assert [r.schema_errors for r in R.check_responses(df).collect()] == [[], ["result has too many items"]]


TEXT = st.one_of(st.sampled_from(list(GOOD.values()) + ["0x", "", "1x", "No token holder found"]), st.text(max_size=5))
LEAF = st.one_of(TEXT, st.integers(0, 9), st.none(), st.booleans())
RECORD = st.one_of(LEAF, st.dictionaries(st.sampled_from([*GOOD, "nonce", "tokenName", "input", "x"]), LEAF, max_size=9))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from(["status", "message", "result", "extra"]),
                                st.one_of(TEXT, LEAF, st.lists(RECORD, max_size=4))), min_size=8, max_size=20))
def test_random_answers(spark, answers):
    compare(spark, answers)


def test_policies_depth_and_malformed_answers(spark):
    deep = json.dumps(answer([{**GOOD, "z": json.loads("[" * 12 + "1" + "]" * 12)}]))
    rows = [("etherscan", "tokentx", "{"), ("etherscan", "tokentx", None), ("etherscan", "tokentx", deep), ("ETHERSCAN", "TokenTx", "{}"),
            ("other", "tokentx", json.dumps({"status": "1"})), (None, None, json.dumps(answer(7)))]
    df = spark.createDataFrame(rows, "source_explorer string, endpoint string, body string")
    got = {p: [r.schema_errors for r in R.check_responses(df, policy=p).collect()] for p in ("fail-closed", "skip", "permissive")}
    assert got["skip"][:4] == [["answer is not JSON"], ["answer is not JSON"], ["answer is nested too deeply"],
                               ["status is required", "message is required", "result is required"]]
    assert got["fail-closed"][4:] == [["no rules for this explorer and endpoint"]] * 2
    assert got["skip"][4:] == [[], []] and got["permissive"][4:] == [["result is required"], []]
    with pytest.raises(ValueError):
        R.check_responses(df, policy="maybe")


@pytest.mark.parametrize("rule", [
    {"kind": "number"}, {"kind": "text", "format": "x"}, {"kind": "text", "like": "uuid"}, {"kind": "object", "fields": {"a": {"kind": "x"}}},
    {"either": [{"kind": "text"}, {"kind": "text"}]}, {"kind": "list", "each": 3}, None])
def test_unknown_rules_are_refused(rule):
    with pytest.raises(ValueError):
        R.check_document(rule, "x")


def test_landed_pages_as_answers(spark):
    df = spark.createDataFrame([("1", 'O"K', "[]"), ("0", "NOTOK", 'say "x"'), (None, None, None)], "status string, message string, result string")
    got = [json.loads(r[0]) for r in df.select(R.answer_text()).collect()]
    assert got == [{"status": "1", "message": 'O"K', "result": []}, {"status": "0", "message": "NOTOK", "result": 'say "x"'}, {}]
