"""Chat formatting at token level (operator 9).

Every turn is a row of its own, so a conversation of any length is formatted in parallel:

    <|turn|> role <|body|> text <|end|>

Role and text are escaped and encoded separately; the three marks are reserved ids beyond the tokenizer's vocabulary
that are spliced between them, so no text can produce one. In the text view control strings inside a role or text are
broken by ESCAPE after their first character (and ESCAPE itself is doubled), which ``unescape`` undoes. The loss mask is
the running sum of +1 where an assistant's body starts and -1 where it ends.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staleguard.llm.arrowtext import texts_of
from staleguard.llm.bpe import byte_letters
from staleguard.llm.shared import text_batches
from staleguard.llm.tokens import library_encoder

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Strings that steer chat templates (fixed values); inside a text they are escaped.
CONTROL = (TURN, BODY, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
LEARNED_ROLE = "assistant"

_risky = re.compile("|".join(re.escape(c) for c in (*CONTROL, ESCAPE)))
_escaped = re.compile(f"{ESCAPE}(.)", re.DOTALL)


def escape(text: str) -> str:
    return _risky.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text) if _risky.search(text) else text


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if ESCAPE in text else text


class ChatCodec:
    """Reserved ids and the exact byte view of a byte-level tokenizer."""

    def __init__(self, path: str):
        self.encoder = library_encoder(path)
        value = {c: b for b, c in enumerate(byte_letters())}
        self.mark = {s: self.encoder.vocabulary + k for k, s in enumerate((TURN, BODY, END))}
        self.bytes_of = {i: bytes(value[c] for c in t) for t, i in self.encoder.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.bytes_of |= {i: s.encode() for s, i in self.mark.items()}
        self.size_of = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.size_of[i] = len(b)

    def spell(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all ids, where each id's bytes start, and their end)."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())), np.concatenate([[0], np.cumsum(self.size_of[ids])])

    def text(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")


@functools.lru_cache(maxsize=2)
def chat_codec(path: str) -> ChatCodec:
    return ChatCodec(path)


def format_turns(df: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """conv, turn, ids, loss (one flag per id) for every row of ``df``; null roles and texts are empty."""
    def run(batches):
        for batch in batches:
            codec = chat_codec(tokenizer)
            roles, texts = texts_of(batch, "__role").to_pylist(), texts_of(batch, "__text").to_pylist()
            encode = lambda col: [np.frombuffer(b, "<u4").astype(np.int32) for b in codec.encoder.encode([escape(t) for t in col])]
            mark = {s: np.array([i], np.int32) for s, i in codec.mark.items()}
            parts, sizes, begin, stop = [], [], [], []
            for role, role_ids, body_ids in zip(roles, encode(roles), encode(texts), strict=True):
                head = len(role_ids) + 2
                parts += [mark[TURN], role_ids, mark[BODY], body_ids, mark[END]]
                sizes.append(head + len(body_ids) + 1)
                begin.append(head)
                stop.append(head + len(body_ids) if role == LEARNED_ROLE else head)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            step = np.zeros(len(flat) + 1, np.int32)
            np.add.at(step, ends[:-1] + np.array(begin, np.int64), 1)
            np.add.at(step, ends[:-1] + np.array(stop, np.int64), -1)
            loss = np.cumsum(step)[:-1] > 0
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(flat)),
                 pa.ListArray.from_arrays(offsets, pa.array(loss))], names=["conv", "turn", "ids", "loss"])

    rows = text_batches(df).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                     F.col(role_col).alias("__role"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, "conv long, turn long, ids array<int>, loss array<boolean>")


def parse_turn(codec: ChatCodec, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, int]:
    """(role, text, text under the loss mask, code points in all) of one formatted turn; its ids are spelled out once."""
    cut = int(np.flatnonzero(ids == codec.mark[BODY])[0])
    if ids[0] != codec.mark[TURN] or ids[-1] != codec.mark[END]:
        raise ValueError("not a formatted turn")
    raw, at = codec.spell(ids)
    learned = b"".join(raw[at[a]:at[b]] for a, b in zip(*np.flatnonzero(np.diff(loss, prepend=False, append=False)).reshape(-1, 2).T))
    return (unescape(raw[at[1]:at[cut]].decode()), unescape(raw[at[cut + 1]:at[-2]].decode()), unescape(learned.decode()), len(raw.decode()))


def conversation_digests(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Reads formatted turns back: one row per conversation with digests of its turns and of the text under the loss mask.

    Rows arrive sorted and are digested one at a time, so memory doesn't grow with a conversation. The digest of
    a conversation is sequential by definition, so all its turns pass through one task. Turns of equal number are
    taken in order of their ids; rows with a null conversation form one conversation, first in order.
    """
    def run(batches):
        codec = chat_codec(tokenizer)

        def rows():
            for batch in batches:
                lists = [batch.column(batch.schema.get_field_index(c)) for c in ("ids", "loss")]
                for conv, ids, loss in zip(batch.column(0).to_pylist(), *lists):
                    yield conv, ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)

        out = []
        for conv, own in itertools.groupby(rows(), key=lambda r: r[0]):
            all_turns, learned, n, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, ids, loss in own:
                role, text, under, size = parse_turn(codec, ids, loss)
                all_turns.update(f"{role}\n{text}\n".encode())
                learned.update(under.encode())
                n, chars, total = n + 1, chars + len(under), total + size
            out.append((conv, n, all_turns.hexdigest(), chars, learned.hexdigest(), total))
            if len(out) >= 1000:
                yield _digest_batch(out)
                out = []
        yield _digest_batch(out)

    return turns.repartition("conv").sortWithinPartitions("conv", "turn", "ids").mapInArrow(
        run, "conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
        names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
