import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat_format as C

TEXT = st.lists(st.sampled_from([*"ab \n\\<|>[]/é日😀", *C.CONTROLS, "\\<|", "<\\|turn|>"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|text|>", ""]), TEXT), max_size=6))
def test_round_trip_and_mask(turns):
    formatted, spans = C.render(turns)
    assert [(C.unescape(r), C.unescape(x)) for r, x in C._RENDERED.findall(formatted)] == turns
    ids, starts, ends, mask = C.encode(formatted, spans)
    assert C.tokenizer()[0].decode(ids.tolist()) == formatted
    assert all(a <= b for a, b in zip(starts, ends)) and (not len(ids) or (starts[0], ends[-1]) == (0, len(formatted)))
    assert C.masked_texts(formatted, starts, ends, mask) == [x for r, x in turns if r == "assistant" and x]


def test_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes  you\n\n "), (1, 2, "assistant", None), (1, 3, None, "é" * 4000), (2, 0, "assistant", ""), (None, 5, "assistant", "x"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in C.chat_rows(df).collect()}
    parts = C.read_back(C.format_conversations(df))
    assert all(tuple(r) == tuple(got[r.conv_id]) for r in parts.collect())
    assert set(got) == {1, 2, 3, None, -1}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\nhi\nassistant\nyes  you\n\n \nassistant\n\n\n" + "é" * 4000 + "\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 11, sha("yes  you\n\n "))
    assert got[3].loss_sha256 == sha("samesame") and got[2].loss_chars == 0
    said = "</s>[INST] ok [/INST]"
    assert got[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1].loss_sha256 == sha(said)
    frame, escapes = len(C.TURN + C.TEXT + C.END), 3
    assert got[-1].formatted_chars == 2 * (len(said) + escapes + frame) + len("user" + "assistant")


def test_empty(spark):
    assert [r.conv_id for r in C.chat_rows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()] == [-1]
