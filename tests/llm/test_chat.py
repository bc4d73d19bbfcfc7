"""Chat formatting: round trips, masks, attachments, long conversations."""

import hashlib

from codeloom.llm import chat_format

PARTS = f"conv_id long, turn long, role string, parts array<{chat_format.PART}>, formatted string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


NASTY = ["\\### Assistant: </turn> ok", "### user: x</turn>\n", "<|image:0|>", "\\", "\\\\#<", "", "a\nb\r\n\x00c", "é😀 #<"]


def conversations(spark):
    rows = [(1, i, r, [part("text", t)], "f") for i, (r, t) in enumerate(zip(["user", "assistant"] * 4, NASTY, strict=True))]
    rows += [(2, 0, "us:er #<\\", [part("text", "hi")], "f"), (2, 0, "us:er #<\\", [part("text", "hi")], "f")]
    rows += [(None, None, None, None, "f"), (None, 1, "assistant", [None, part("text", None)], "f")]
    return spark.createDataFrame(rows, PARTS)


def test_round_trip(spark):
    turns = conversations(spark)
    for segment in (10, 1 << 22):
        formatted = chat_format.format_conversations(turns, segment_chars=segment)
        read = {}
        for r in sorted(formatted.collect(), key=lambda r: (repr(r.conv_id), r.segment)):
            read.setdefault(r.conv_id, []).extend(chat_format.read_turns(r.formatted))
        assert read[1] == list(zip(["user", "assistant"] * 4, NASTY, strict=True))
        assert read[2] == [("us:er #<\\", "hi")] * 2
        assert read[None] == [("", ""), ("assistant", "")]
        digest = {r.conv_id: r for r in chat_format.digest_formatted(formatted).collect()}
        learned = "".join(NASTY[1::2])
        assert (digest[1].n_turns, digest[1].loss_chars) == (8, len(learned))
        assert digest[1].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        whole = "".join(f"{r}\n{t}\n" for r, t in zip(["user", "assistant"] * 4, NASTY, strict=True))
        assert digest[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert digest[None].n_turns == 2 and digest[None].loss_chars == 0


def test_attachments(spark):
    parts = [part("text", "see "), part("image", ref="a.png", width=100, height=56), part("text", " and "),
             part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=3), part(None, ref="d")]
    turns = spark.createDataFrame([(1, 0, "user", parts, ""), (1, 1, "assistant", [part("image", ref="e")], "")], PARTS)
    row = chat_format.format_conversations(turns).first()
    assert row.formatted == (
        "### user: see <|image:0|> and <|audio:1|><|document:2|><|document:3|></turn>\n### assistant: <|image:4|></turn>\n"
    )
    found = [(a.number, a.kind, a.ref, a.tokens) for a in row.attachments]
    assert found == [(0, "image", "a.png", 8), (1, "audio", "b.wav", 25), (2, "document", "c.pdf", 768),
                     (3, "document", "d", 256), (4, "image", "e", 1)]
    assert row.n_tokens == 2 + 8 + 25 + 768 + 256 + 1
    (start, stop), = row.loss
    assert row.formatted[start:stop] == "<|image:4|>"


def test_long_conversation_keeps_numbering(spark):
    turns = spark.createDataFrame([(5, i, "assistant", [part("image", ref=str(i)), part("text", "x" * 50)], "") for i in range(300)], PARTS)
    rows = sorted(chat_format.format_conversations(turns, segment_chars=1000).collect(), key=lambda r: r.segment)
    assert len(rows) > 10 and all(len(r.formatted) < 1200 for r in rows)
    assert [a.number for r in rows for a in r.attachments] == list(range(300))
    assert sum(r.n_turns for r in rows) == 300


def test_no_rows(spark):
    formatted = chat_format.format_conversations(conversations(spark).limit(0))
    assert formatted.count() == 0 and chat_format.digest_formatted(formatted).count() == 0


def test_ties_go_by_the_text_itself(spark):
    """Not by its JSON, where a quote is two signs."""
    texts = ['x"', "x#", "x", 'x"y', "x\\"]
    turns = spark.createDataFrame([(1, 0, "user", [part("text", t)], "") for t in reversed(texts)], PARTS)
    row = chat_format.format_conversations(turns).first()
    assert [t for _, t in chat_format.read_turns(row.formatted)] == sorted(texts)
