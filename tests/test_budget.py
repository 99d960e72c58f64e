"""The budget of characters: what must hold of every text, and cases worked out by hand."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.operators.context import CUT, DEGRADED_OMITTED, SPENT, SUCCESS_OMITTED, within_budget

KIND = "array<struct<tool:string,status:string,summary:string,error:string,code:string>>"
START = re.compile(r"^\[(ERROR|DEGRADED|OK)\] ", re.M)

word = st.integers(0, 400).map(lambda n: ("ab cd" * 90)[:n])
record = st.tuples(st.sampled_from("abc"), st.sampled_from(["error", "timeout", "degraded", "success"]), word, st.none() | word, st.none() | st.just("E1"))


@pytest.fixture(scope="module")
def texts(spark):
    """Many (records, head, most, text)."""
    cases = []

    @settings(max_examples=150, deadline=None, derandomize=True, database=None)
    @given(st.lists(record, max_size=9), st.sampled_from([None, "", "plan", "p" * 150]), st.sampled_from([300, 600, 2000, 100_000]))
    def collect(records, head, most):
        cases.append((len(cases), records, head, most))

    collect()
    df = spark.createDataFrame(cases, f"i int, r {KIND}, head string, most int").cache()
    out = []
    for most in (300, 600, 2000, 100_000):
        for row in df.where(F.col("most") == most).select("i", within_budget(F.col("r"), F.col("head"), most).alias("t")).collect():
            out.append((*cases[row["i"]][1:], row["t"]))
    assert len(out) == len(cases)
    return out


def test_kinds_stand_in_order_after_the_head(texts):
    for records, head, _, text in texts:
        kinds = START.findall(text)
        assert kinds == sorted(kinds, key=["ERROR", "DEGRADED", "OK"].index)
        if head:
            assert text.startswith(head)
        assert kinds.count("ERROR") <= sum(r[1] in ("error", "timeout") for r in records)
        assert kinds.count("DEGRADED") <= sum(r[1] == "degraded" for r in records)


def test_length_stays_near_the_budget(texts):
    for records, _, most, text in texts:
        # Beyond it: line breaks, a note at the end, and notes on degraded results, which cost 50 each.
        names = len("[OK] Success tools (9): ") + 3 * len(records)
        assert len(text) <= most + len(records) + len(SPENT) + 2 + 12 * sum(r[1] == "degraded" for r in records) + max(names, len(SUCCESS_OMITTED) + 6)


def test_a_spent_budget_ends_the_text(texts):
    assert any(SPENT in t for *_, t in texts)
    for records, _, _, text in texts:
        if SPENT in text:
            assert text.endswith(SPENT) and set(START.findall(text)) == {"ERROR"}
        else:
            assert START.findall(text).count("ERROR") == sum(r[1] in ("error", "timeout") for r in records)
        if CUT in text:
            assert text.count(CUT) == 1 and text.endswith("\n".join([CUT, SPENT]))


def test_with_room_every_record_has_its_share(texts):
    for records, _, most, text in texts:
        if most == 100_000:
            good = [r for r in records if r[1] == "success"]
            for tool, status, summary, error, code in records:
                if status in ("error", "timeout"):
                    assert f"[ERROR] {tool} [{code or 'UNKNOWN'}]\n   Result: {summary[:300]}\n   Diagnostic: {'(no error detail)' if error is None else error[:200]}" in text
                else:
                    assert f"[{'OK' if status == 'success' else 'DEGRADED'}] {tool}: {summary[: 120 if status == 'success' else 200]}" in text
            assert text.count("[OK]") == len(good) and DEGRADED_OMITTED not in text and SUCCESS_OMITTED not in text


def test_successes_share_what_is_left(texts):
    for records, _, most, text in texts:
        n = sum(r[1] == "success" for r in records)
        for line in re.findall(r"^\[OK\] [abc]: (.*)$", text, re.M):
            assert line.startswith("[success") or len(line) <= min(120, max(60, most // n) - 30)


LONG = "x" * 400


@pytest.mark.parametrize("records, head, most, text", [
    ([], "plan", 300, "plan"), ([], None, 300, ""),
    ([("a", "success", "hi", None, None)], None, 300, "[OK] a: hi"),
    ([("a", "error", "boom", None, None)], "", 300, "[ERROR] a [UNKNOWN]\n   Result: boom\n   Diagnostic: (no error detail)"),
    # 150 are left: half of them each, 192 with the labels, so 100 stay before the mark.
    ([("a", "timeout", LONG, LONG, "E1")], "p" * 150, 300, "p" * 150 + "\n[ERROR] a [E1]\n   Result: " + "x" * 74 + CUT + "\n" + SPENT),
    ([("a", "success", LONG, None, None), ("b", "success", "", None, None)], "p" * 150, 300, "p" * 150 + "\n[OK] Success tools (2): a, b"),
    # Two share 300: 120 characters each; the second line would need 128 of 172, and fits.
    ([("a", "success", LONG, None, None), ("b", "success", LONG, None, None)], None, 300, "[OK] a: " + "x" * 120 + "\n[OK] b: " + "x" * 120),
    ([("a", "degraded", LONG, None, None), ("b", "degraded", LONG, None, None)], None, 300, "[DEGRADED] a: " + "x" * 200 + "\n[DEGRADED] b" + DEGRADED_OMITTED),
])
def test_worked_cases(spark, records, head, most, text):
    df = spark.createDataFrame([(records, head)], f"r {KIND}, head string")
    assert df.select(within_budget(F.col("r"), F.col("head"), most)).first()[0] == text


def test_own_guard_rules_come_first(spark):
    from quillstream.operators.plans import default_guard_rules, guard_violations

    steps = spark.createDataFrame([(1, "d", 0, "order_lookup", 0, -1), (1, "d", 1, "crm_send_coupon", 3, 0)], "user_id int, day string, step int, tool string, k int, dep int")
    own = ("order_lookup", "crm_send_coupon", F.lit(False), "mine")
    assert [r["message"] for r in guard_violations(steps, default_guard_rules()).collect()] == ["no orders: no coupon"]
    assert [r["message"] for r in guard_violations(steps, [own, *default_guard_rules()]).collect()] == ["mine"]


def test_cycles_of_several_dependencies(spark):
    from quillstream.operators.plans import unfinished

    plans = [([[], [0], [0, 1]], 0), ([[1], [0], []], 2), ([[0]], 1), ([[9], [-1]], 0), ([[1], [2], [1]], 3)]
    df = spark.createDataFrame([(p, n) for p, n in plans], "deps array<array<int>>, n int")
    assert all(r["m"] == r["n"] for r in df.select("n", unfinished(F.col("deps")).alias("m")).collect())
