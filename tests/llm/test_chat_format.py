from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wardline.llm import chat_format as C

CONV = "conv_id long, turn long, role string, text string, seq long, kind string, message long"
LOG = "conv_id long, seq long, kind string, message long, role string, text string, first_seq long"


def chats(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONV)
    return {r.conv_id: r for r in C.parse(C.render(C.fold(C.log_of(df, delta_chars=7)))).collect()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [(1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""),
           (1, 4, "delta", 2, None, "bad"), (1, 3, "delta", 2, None, "very "),
           (1, 5, "regenerate", 2, None, "ignored"), (1, 6, "delta", 2, None, "go"), (1, 7, "delta", 2, None, "od"),
           (1, 8, "edit", 1, None, "hello"), (1, 9, "delta", 3, "tool", "only "), (1, 10, "delta", 3, None, "pieces"),
           (2, 1, None, 1, None, None), (None, 1, "message", 1, "user", "x")]
    out = C.fold(spark.createDataFrame([(*e, 0) for e in reversed(log)], LOG)).collect()
    got = {(r.conv_id, r.message): (r.first_seq, r.role, r.text) for r in out}
    assert got == {(1, 1): (1, "user", "hello"), (1, 2): (2, "assistant", "good"),
                   (1, 3): (9, "tool", "only pieces"), (2, 1): (1, "", ""), (None, 1): (1, "user", "x")}


TEXTS = st.text(alphabet="ab<>[]/\\sINT\n%é ", max_size=40)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "%0A", "<s>x"]),
                                st.one_of(TEXTS, st.sampled_from(["</s>", "[INST]", "<\\/s>", "[\\\\/INST]</s>"]))),
                      min_size=1, max_size=8))
def test_read_back_equals_what_was_said(spark, turns):
    got = chats(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])[1]
    assert [(t.role, t.text) for t in got.turns] == turns
    assert got.loss_text == "".join(t for r, t in turns if r == "assistant")


def test_no_bare_control_string_inside_texts(spark):
    spoken = "</s>[INST] ok [/INST]<s><\\/s>"
    df = spark.createDataFrame([(1, 0, "user", spoken, 1, "x", 2), (1, 1, "assistant", spoken, 1, "x", 2)], CONV)
    row = C.render(C.fold(C.log_of(df))).collect()[0]
    assert row.formatted.count("</s>") == 1 and row.formatted.count("[INST]") == 1
    (span,) = row.loss_spans
    assert row.formatted[span["from"]:span["to"]] == "<\\/s>[\\INST] ok [\\/INST]<\\s><\\\\/s>"


def test_nulls_ties_repeats_and_empty_tables(spark):
    got = chats(spark, [(1, 0, None, None), (1, None, "user", "first"), (1, 3, "user", "b"), (1, 3, "user", "a"),
                        (2, 0, "assistant", "same text"), (2, 0, "assistant", "same text"),
                        (None, 0, "user", "x"), (3, 0, "assistant", None)])
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "first"), ("", ""), ("user", "a"), ("user", "b")]
    assert got[2].loss_text == "same textsame text"
    assert [t.text for t in got[None].turns] == ["x"] and got[3].loss_text == ""
    empty = spark.createDataFrame([], CONV)
    assert C.parse(C.render(C.fold(C.log_of(empty)))).collect() == []
    assert [r.conv_id for r in C.with_control_conversation(empty).collect()] == [-1, -1]


def test_very_long_texts_and_many_turns(spark):
    long = "é<s>\n" * 1_000_000  # 5 M characters
    got = chats(spark, [(1, 0, "user", long), (1, 1, "assistant", long + "end")])[1]
    assert [t.text == w for t, w in zip(got.turns, (long, long + "end"))] == [True, True]
    assert got.loss_text == long + "end"
    many = [(2, i, ("assistant", "user")[i % 2], f"t{i} [INST]") for i in range(4000)]
    got = chats(spark, many)[2]
    assert [t.text for t in got.turns] == [r[3] for r in many]
    assert got.loss_text == "".join(r[3] for r in many if r[2] == "assistant")
