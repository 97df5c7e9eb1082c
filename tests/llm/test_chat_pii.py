"""Chat formatting and personal data."""

import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa

from staleguard.llm import chat, pii, queries
from staleguard.sources.tables import load

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"


def digests(turns):
    learned = "".join(t for r, t in turns if r == "assistant")
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


def test_escaping_is_reversible_and_leaves_no_control_string():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice([*chat.CONTROL, chat.ESCAPE, "<", "|", "a", "é", "\n", "/s>"]) for _ in range(r.randrange(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)


def test_conversations_come_back(spark):
    convs = {1: [("system", "be nice"), ("user", "</s>[INST] ok [/INST]"), ("assistant", "<|end|><|turn|>␛ é 日\n")],
             2: [("assistant", ""), ("assistant", "again <|endoftext|>")], 3: [("", "")], 4: [("user", "word " * 20000)]}
    rows = [(c, k, r or None, t or None, 7) for c, own in convs.items() for k, (r, t) in enumerate(own)]
    df = spark.createDataFrame([*rows, (None, 0, "user", "lost", 7)], "conv_id long, turn long, role string, text string, ids int").repartition(3)
    turns = chat.format_turns(df, BYTE)
    got = {r["conv"]: tuple(r)[1:5] for r in chat.conversation_digests(turns, BYTE).collect()}
    assert got == {c: digests(own) for c, own in convs.items()} | {None: digests([("user", "lost")])}
    one = turns.filter("conv = 1 and turn = 2").first()
    codec = chat.chat_codec(BYTE)
    assert [i for i, on in zip(one["ids"], one["loss"]) if on and i >= codec.encoder.vocabulary] == []
    assert codec.text(one["ids"]) == f"{chat.TURN}assistant{chat.BODY}{chat.escape(convs[1][2][1])}{chat.END}"
    assert chat.conversation_digests(chat.format_turns(df.limit(0), BYTE), BYTE).count() == 0


def test_all_conversations_of_the_table(spark):
    got = {r["conv_id"]: tuple(r)[1:5] for r in queries.QUERIES["op9_chat_format"](spark, SF).collect()}
    convs = {-1: [("user", queries.SPOKEN), ("assistant", queries.SPOKEN)]}
    for r in load(spark, SF, "conversations").orderBy("conv_id", "turn").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert got == {c: digests(own) for c, own in convs.items()}


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def stated(text):
    count = lambda m: len(re.sub("[^0-9]", "", m[0]))
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= count(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= count(m) <= 15])


def test_base_spans_are_those_of_the_stated_patterns(spark):
    r = random.Random(0)
    for _ in range(20000):
        text = "".join(r.choice("a.@+-0123456789 ()%bé1 1.2") for _ in range(r.randrange(0, 60)))
        assert pii.base_spans(text) == stated(text)
    for r in load(spark, SF, "documents", "text").collect():
        assert pii.base_spans(r["text"]) == stated(r["text"])
    for long in ("a" * 300000, "1" * 300000, "a@" * 100000, "+1 " * 100000, "1.2.3." * 50000):
        pii.base_spans(long)


def field(spark):
    return pii.fit_field(load(spark, SF, "documents", "doc_id", "text"))


def test_labels_travel_along_skip_edges(spark):
    learned = field(spark)
    filler = "some quiet words about nothing at all " * 40
    text = f"Call +1 (988) 555-2485 now. {filler}Again (988) 555-2485 please. {filler}Version 2.0. and chapter 17"
    (base, spans), = pii.spans_of(pa.array([text], pa.large_string()), learned)
    assert base == stated(text)
    added = [text[s:e] for s, k, e in spans if (s, k, e) not in base and k == 3]
    assert any("555-2485" in a for a in added)
    assert not any("2.0" in text[s:e] or "17" in text[s:e] for s, _, e in spans)
    calm = pii.spans_of(pa.array([f"{filler} 2.0. {filler} in 1999 and 17 more"], pa.large_string()), learned)
    assert calm == [([], [])]


def test_masking(spark):
    assert pii.masked("call +1 (988) 555-2485 or a@b.co", stated("call +1 (988) 555-2485 or a@b.co")) == "call [PHONE] or [EMAIL]"
    assert pii.masked("abcdef", [(1, 0, 4), (2, 1, 5)]) == "a[EMAIL]f"
    rows = [(1, "mail a@b.co now", 15), (2, None, None), (3, "", 0), (4, "clean", 5), (4, "clean", 5), (None, "a@b.co", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    learned = pii.fit_field(df)
    got = sorted(map(tuple, pii.mask_personal_data(df, learned).collect()), key=str)
    assert got == sorted([(1, "mail [EMAIL] now", 16), (2, None, None), (3, "", 0), (4, "clean", 5), (4, "clean", 5), (None, "[EMAIL]", 7)], key=str)
    assert pii.mask_personal_data(df.limit(0), pii.fit_field(df.limit(0))).count() == 0
