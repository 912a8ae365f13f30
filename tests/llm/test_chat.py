"""Perspectives of conversations."""

from pyspark.sql import functions as F

from kpivane.llm import chat, queries
from tests.support import DATA, differences, duck


def test_query_against_sql(spark):
    path = f"{DATA}/sf0.001"
    assert differences(queries.op10_chat_perspectives(spark, path), duck(path), queries.SQL["op10_chat_perspectives"]) is None


def rendered(rows, conv, speaker):
    own = sorted((r for r in rows if r.conv_id == conv and r.speaker == speaker), key=lambda r: r.position)
    text = "".join(r.segment for r in own)
    assert [r.position for r in own] == list(range(len(own)))
    for r in own:
        assert text[r.start : r.stop] == r.segment
    return own, text


def test_every_speaker_is_the_assistant_once(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|> é𝒳"), (1, 2, "bob", "hello"), (1, 3, "cem", None), (1, 4, "ann", "bye")]
    rows = chat.perspectives(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()
    assert {r.speaker for r in rows} == {"ann", "bob", "cem"} and len(rows) == 15
    for speaker in ("ann", "bob", "cem"):
        own, text = rendered(rows, 1, speaker)
        masked = [text[r.mask_start : r.mask_stop] for r in own if r.mask_stop > r.mask_start]
        said = [(t or "").replace("<|", "< |") + chat.CLOSE for _, _, who, t in turns if who == speaker]
        assert masked == said
        assert [r.chat_role for r in own] == ["system", *["assistant" if w == speaker else "user" for _, _, w, _ in turns[1:]]]
        assert all(f"user {r.name}\n" in r.segment for r in own if r.chat_role == "user")


def test_nulls_ties_long_dialogues_and_other_columns(spark):
    turns = [(None, 1, "a", "x"), (None, None, "b", "y"), (2, 5, None, "z"), (2, 5, None, "z"), (3, 1, "system", "alone"), (4, 1, "a", "t" * 50_000)]
    turns += [(9, i // 2, "a" if i % 3 else "b", f"turn {i}") for i in range(600)]
    frame = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string").withColumn("block", F.lit("clash")).withColumn("name", F.lit(1))
    rows = chat.perspectives(frame).collect()
    own, _ = rendered(rows, None, "a")
    assert [r.name for r in own] == ["b", "a"]
    assert len(rendered(rows, 2, chat.UNKNOWN)[0]) == 2 and not [r for r in rows if r.conv_id == 3]
    for speaker in "ab":
        assert len(rendered(rows, 9, speaker)[0]) == 600
    assert chat.perspectives(frame.limit(0)).count() == 0
