"""Chat formatting: segments encoded one by one, reserved ids spliced between them, masks from prefix sums.

A turn is  <|im_start|>role \\n text <|im_end|> \\n  . The two marks are reserved ids above the vocabulary and never come out
of encoding. In role and text, "<" + k backslashes + "|" gets one more backslash, so the formatted string has "<|" in marks alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickforge.llm.common import partitions, prepare

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
START, END = "<|im_start|>", "<|im_end|>"
#: Reserved ids: the first two above the vocabulary's 50,257.
START_ID, END_ID = 50257, 50258
LOSS_ROLE = "assistant"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _header(role: str) -> str:
    """A role in one line."""
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _role(header: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], header))


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer.from_file(path)
        _LOADED[path].encode_special_tokens = True
    return _LOADED[path]


def assemble(parts: list[tuple[list[int], bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the segments put together, and their loss mask by a prefix sum over segment ends."""
    ends = np.cumsum([len(ids) for ids, _ in parts])
    step = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int8)
    for (ids, loss), end in zip(parts, ends):
        if loss and ids:
            step[end - len(ids)] += 1
            step[end] -= 1
    ids = np.array([i for part, _ in parts for i in part], np.int32)
    return ids, np.cumsum(step[:-1]).astype(bool)


def format_turns(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """conv_id, turn, ids and mask (little-endian int32 and bytes of 0 and 1) and chars, the length of the formatted turn. Null role or text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            out_ids, out_mask, chars = [], [], []
            roles, texts = ([x or "" for x in batch.column(c).to_pylist()] for c in ("role", "text"))
            for i in range(0, len(roles), 256):
                heads = [_header(x) + "\n" for x in roles[i : i + 256]]
                bodies = [escape(x) for x in texts[i : i + 256]]
                codes = [e.ids for e in encode.encode_batch_fast([*heads, *bodies, "\n"], add_special_tokens=False)]
                for k, head in enumerate(heads):
                    ids, mask = assemble([([START_ID], False), (codes[k], False), (codes[len(heads) + k], roles[i + k] == LOSS_ROLE), ([END_ID], False), (codes[-1], False)])
                    out_ids.append(ids.astype("<i4").tobytes())
                    out_mask.append(mask.astype(np.uint8).tobytes())
                    chars.append(len(START) + len(head) + len(bodies[k]) + len(END) + 1)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(out_ids, pa.binary()), pa.array(out_mask, pa.binary()), pa.array(chars, pa.int64())], names=["conv_id", "turn", "ids", "mask", "chars"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, ids binary, mask binary, chars long")


def read_turn(ids: np.ndarray, mask: np.ndarray, decode: Tokenizer) -> tuple[str, str, str]:
    """Role, text and text under the mask of one formatted turn, from its tokens alone."""
    assert ids[0] == START_ID and END_ID in ids
    end = int(np.flatnonzero(ids == END_ID)[-1])
    header, _, body = decode.decode(ids[1:end].tolist(), skip_special_tokens=False).partition("\n")
    under = decode.decode(ids[mask.astype(bool)].tolist(), skip_special_tokens=False)
    return _role(header), unescape(body), unescape(under)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(formatted: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """What the formatted turns say when read back, a row for each conversation.

    Turns come in order, ties in the order of their tokens. A task reads a conversation as a stream and keeps running hashes
    alone, so a conversation may be of any length. A null conv_id is a conversation of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, at, out = tokenizer(path), None, []

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        def close() -> None:
            if at is not None:
                out.append((at[0], n, turns.hexdigest(), under, loss.hexdigest(), chars))

        for batch in batches:
            for conv, ids, mask, c in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "ids", "mask", "chars"))):
                if at is None or at[0] != conv:
                    close()
                    at, n, under, chars, turns, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text, covered = read_turn(np.frombuffer(ids, "<i4"), np.frombuffer(mask, np.uint8), decode)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(covered.encode())
                n, under, chars = n + 1, under + len(covered), chars + c
            if len(out) > 5000:
                yield batch_of()
                out.clear()
        close()
        yield batch_of()

    dealt = formatted.repartition(partitions(formatted), "conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    return dealt.mapInArrow(run, _DIGEST)


def format_and_digest(turns: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Format all turns (conv_id, turn, role, text) and say what the result says when read back, a row for each conversation.

    Null role or text is empty; rows that repeat count each, ties in turn go by their tokens; a null conv_id is a conversation of its own, a null
    turn comes first. Texts are encoded whole, however long. Other columns are not looked at. An empty table gives none.
    """
    prepare(turns.sparkSession)
    return digest(format_turns(turns, path), path)
