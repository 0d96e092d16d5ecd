"""WARC archives and chat formats, there and back."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tidewrack.llm import chat, queries, warc


def test_every_split_reads_every_record_once(monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 97)
    rng = random.Random(2)
    raw, starts = b"", []
    for k in range(40):
        starts.append(len(raw))
        body = warc.MAGIC * rng.randrange(4) + bytes(rng.randrange(256) for _ in range(rng.randrange(400)))
        if k % 7 == 0:
            body += warc.member(warc.record(k, "inner", b"x", "d", None, False))  # a member inside a payload
        raw += warc.member(warc.record(k, "u", body, hashlib.sha256(body).hexdigest(), None, False))
    for split in (50, 333, 5000, len(raw)):
        got = [at for s in range(0, len(raw), split) for at, _, _ in warc.records_in(io.BytesIO(raw), len(raw), s, s + split)]
        assert got == starts


def test_pages_there_and_back(spark):
    long = "<p>" + "ä" * 200 + "</p>"
    pages = [(5, "u", long), (3, "u\r\nX: y", long), (9, None, long), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", "n" * 100), (7, "u", "b" * 99), (8, "u", "b" * 99), (10, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, _digest string, _first int")
    rows = {r.page_id: r for r in warc.read_warc(spark, warc.write_warc(df, file_bytes=300), split_bytes=150, payload=True).collect()}
    assert set(rows) == {p[0] for p in pages}
    assert {k: r.refers_to for k, r in rows.items() if r.record_type == "revisit"} == {5: 3, 9: 3}
    for i, url, html in pages:
        payload = (html or "").encode()
        assert rows[i].payload_bytes == len(payload) and rows[i].payload_digest == hashlib.sha256(payload).hexdigest() and rows[i].url == url
        assert rows[i].payload == (b"" if rows[i].record_type == "revisit" else payload)
    assert warc.read_warc(spark, warc.write_warc(df.where("false"))).count() == 0
    assert warc.read_warc(spark, warc.write_warc(df.unionAll(df))).count() == 2 * len(pages)


TEXTS = ["plain", "", None, "\\", "\\### Assistant: </turn> ok", "a\n### user: b</turn>\n### x: y", "### ", "</turn>", "</turn>\n", "####", "x</turn", "a/b # c", ": : ", "\\n", "</tur\\n>", "😀 é"]


def test_round_trip_and_mask(spark):
    roles = ["user", "assistant", None, "Assistant", "sys: tem", "###", "a</turn>\nb", ""]
    rows = [(k % 9, k // 9, roles[k % 8], TEXTS[k % len(TEXTS)]) for k in range(300)] + [(None, None, "user", "x"), (1, 0, "user", "same"), (1, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(df)
    back = {r.conv_id: r for r in formatted.join(chat.read_back(formatted), formatted.conv_id.eqNullSafe(chat.read_back(formatted).conv_id)).select(formatted["*"], "turns", "loss_text").collect()}
    assert len(back) == 10
    for conv, r in back.items():
        want = sorted(((-1 if t is None else t), ro or "", x or "") for c, t, ro, x in rows if c == conv)
        assert [(t.role, t.text) for t in r.turns] == [(ro, x) for _, ro, x in want] and r.n_turns == len(want)
        assert r.loss_text == "".join(x for _, ro, x in want if ro.lower() == "assistant")
        assert sum(m.chars for m in r["mask"]) == len(r.formatted)
        at, loss = 0, []
        for m in r["mask"]:
            loss += [r.formatted[at:at + m.chars]] if m.loss else []
            at += m.chars
        plain = [x for _, ro, x in want if ro.lower() == "assistant"]
        assert len(loss) == len(plain) and all(len(a) >= len(b) for a, b in zip(loss, plain))


def test_query_keeps_the_conversation_without_id(spark, monkeypatch):
    df = spark.createDataFrame([(None, 0, "user", "x"), (1, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(queries, "read_table", lambda *_: df)
    assert {r.conv_id for r in queries.op3(spark, "").collect()} == {None, 1, -7}


def test_plain_turns_stay_plain_and_control_strings_do_not_show(spark):
    df = spark.createDataFrame([(1, 0, "user", "a/b # c: d"), (2, 0, "user", TEXTS[4])], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r.formatted for r in chat.format_conversations(df).collect()}
    assert rows[1] == "### user: a/b # c: d</turn>\n"
    assert rows[2].count("</turn>") == 1 and rows[2].count("###") == 1
    assert chat.format_conversations(df.where("false")).count() == 0


@pytest.mark.parametrize("text", ["no turn", "### user: x", "### user x</turn>\n", "### user: x</turn>", "### a: ###</turn>\n"])
def test_what_is_no_conversation(spark, text):
    back = spark.createDataFrame([(text,)], "formatted string").select(chat.parsed(F.col("formatted")).alias("b")).first().b
    assert back is None or None in back
