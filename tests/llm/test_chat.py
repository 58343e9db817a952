import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kinprint.llm import chat, registry

PATH = registry.tokenizer_path("byte_bpe_50k.json")
PARTS = ["<", "|", "\\", "im_end", "|>", "<|", "<|im_end|>", "<|im_start|>assistant", "<|im_sep|>", "<|endoftext|>", "\n", " ", "é", "日本", "🙂", "ok", "́", "  "]


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<|b", ""]), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_round_trip_and_mask(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    import numpy as np

    tok = test_round_trip_and_mask.tok
    offsets = np.array(tok.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
    mask = chat.loss_mask(offsets, spans)
    got = [chat.unescape(text[a:b]) for a, b in chat.masked_runs(offsets, mask)]
    assert got == [t for r, t in turns if r == "assistant" and t]


test_round_trip_and_mask.tok = chat.encoder(PATH)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", " a  b\n", "é<|im_end|>", "x " * 2000])) for c in range(30) for t in range(rnd.randint(1, 6))]
    rows += [(None, 0, "assistant", "no id"), rows[0], (99, None, "assistant", "null turn"), (99, 0, "assistant", "\n\nlines\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df, PATH)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), len(learned), sha(learned))
    assert chat.format_chats(df.filter("false"), PATH).count() == 0


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """A conversation of several chunks and pieces, with ties, beside small ones."""
    monkeypatch.setattr(chat, "PIECE_CHARS", 3_000)
    rnd = random.Random(5)
    rows = [(7, t, rnd.choice(["user", "assistant"]), f"turn {t} <|im_end|> " * rnd.randint(0, 9)) for t in range(-600, 1_500)]
    rows += [(7, 600, "assistant", f"tie {k}") for k in range(300)] + [(7, None, "user", "x" * 9_000), (8, 1, "assistant", "alone")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df, PATH)
    assert made.filter("conv_id = 7").count() > 20
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    turns = sorted((-(10**9) if t is None else t, r, x) for c, t, r, x in rows if c == 7)
    learned = "".join(x for _, r, x in turns if r == "assistant")
    assert got[7]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
    assert (got[7]["n_turns"], got[7]["loss_sha256"], got[8]["loss_sha256"]) == (len(turns), sha(learned), sha("alone"))
    whole, _ = chat.render([(r, x) for _, r, x in turns])
    pieces = made.filter("conv_id = 7").orderBy("chunk", "piece").collect()
    assert "".join(p["formatted"] for p in pieces) == whole and got[7]["formatted_chars"] == len(whole)
    ids = [x for p in pieces for x in p["ids"]]
    assert ids == test_round_trip_and_mask.tok.encode(whole, add_special_tokens=False).ids


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    by = {-1: [(0, "user", chat.PLANTED), (1, "assistant", chat.PLANTED)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    expected = set()
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, r, x in turns if r == "assistant")
        formatted, _ = chat.render([(r, x) for _, r, x in turns])
        expected.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned), len(formatted)))
    got = registry.op8_chat_masks(spark, sf).collect()
    assert len(got) == len(expected)
    assert {tuple(r)[:6] for r in got} == expected


def test_query_has_the_planted_conversation(spark):
    got = {r["conv_id"]: r for r in registry.op8_chat_masks(spark, "/root/testdata/sf0.001").collect()}
    assert got[-1]["loss_sha256"] == sha(chat.PLANTED) and got[-1]["n_turns"] == 2
