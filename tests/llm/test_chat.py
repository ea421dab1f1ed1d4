import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from swingkit.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, blocks int"
TRAPS = ["", "\\", "<", "[", "</s>", "<\\/s>", "<\\\\/s>", "<<s>", "[[TEXT]", "[INST] a [/INST]", "<s>[NEXT]</s>", "\n", "é\U0001f600", "[TEXT", "$1", "a" * 50]


def formatted(turns):
    """A plain writer of the same format."""
    esc = lambda s: re.sub(r"<(?=\\*/?s>)|\[(?=\\*(?:TEXT|NEXT|/?INST)\])", lambda m: m[0] + "\\", s)
    out, spans, last = "", [], None
    for role, text in turns:
        if role == last:
            out = out.removesuffix("</s>") + "[NEXT]"
        else:
            out += f"<s>{esc(role)}[TEXT]"
        at = len(out.encode())
        if role == "assistant":
            spans.append((at, len(esc(text).encode())))
        out, last = out + esc(text) + "</s>", role
    return out, spans


def read(spark, rows):
    made = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    return made.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()


def test_round_trip_of_traps(spark):
    """Every pair of traps as role and text, and as neighbours of one role."""
    rows, want = [], {}
    for c, a in enumerate(TRAPS):
        turns = [(role, a + b) for b in TRAPS for role in ("user", "assistant", "assistant", b)]
        want[c] = turns
        rows += [(c, k, role, text, "x", 1) for k, (role, text) in enumerate(turns)]
    for r in read(spark, rows[::-1]):
        assert (r.formatted, [tuple(s) for s in r.loss_spans]) == formatted(want[r.conv_id])
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert r.loss == [t for role, t in want[r.conv_id] if role == "assistant"]
        assert not re.search(r"\[/?INST\]", r.formatted)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "s>"]), st.text("<[\\/sTEXINST]> ", max_size=12)), max_size=9), max_size=30))
def test_round_trip_of_any_text(spark, chats):
    rows = [(c, k, role, text, None, None) for c, turns in enumerate(chats) for k, (role, text) in enumerate(turns)]
    got = {r.conv_id: r for r in read(spark, rows)} if rows else {}
    for c, turns in enumerate(chats):
        if turns:
            assert [tuple(t) for t in got[c].turns] == turns and got[c].formatted == formatted(turns)[0]


def test_nulls_repeats_ties_and_no_rows(spark):
    """Null turns come first, then by turn, role and text; null roles and texts are empty; null conversations are one."""
    rows = [(1, 2, "user", "b", None, 1), (1, 2, "user", "b", None, 1), (1, 2, "assistant", "a", None, 2), (1, None, "user", None, None, 1), (1, 0, None, "z", None, 1), (None, 1, "user", "n", None, 1), (None, 0, "assistant", "m", None, 1)]
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in read(spark, rows)}
    assert got == {1: [("user", ""), ("", "z"), ("assistant", "a"), ("user", "b"), ("user", "b")], None: [("assistant", "m"), ("user", "n")]}
    assert read(spark, []) == []


def test_long_texts_and_many_turns(spark):
    turns = [("assistant" if k % 3 else "user", f"[INST]{k}" * (20_000 if k == 7 else 1)) for k in range(3000)]
    (r,) = read(spark, [(5, k, role, text, None, None) for k, (role, text) in enumerate(turns)])
    assert [tuple(t) for t in r.turns] == turns and r.formatted == formatted(turns)[0]


def test_query_has_the_added_conversation(spark):
    got = {r.conv_id: r for r in chat.op12_relational_chat(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (got[-1].n_turns, got[-1].loss_chars, got[-1].loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    plan = chat.op12_relational_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
