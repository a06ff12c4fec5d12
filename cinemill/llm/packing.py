"""Vector bin packing of token sequences: simultaneous limits on tokens, segments and loss-bearing tokens.

Each task packs the rows of its own partition, block by block, so packing needs no shuffle and no
block outgrows memory. Within a block, the open sequence has a residual vector (tokens, segments,
loss-bearing tokens, each as a share of its limit) and every waiting example a demand vector; the
fitting example with the largest dot product of the two goes in. Where none fits, the example with
the largest product is cut to the room left, so sequences come out full. What remains at the end of
a block is cut into sequences whose lengths are powers of two, which take no padding.

Defined cases: null text is empty (its end id is its only token); repeated rows are packed once
each; an empty table gives an empty result; input columns besides id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinemill.llm.common import table
from cinemill.llm.tokens import encoder, tokenizer_path

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, "
    "sequence_id long, offset long, sequence_tokens long, ids binary"
)


def _fit(start: int, prompt: int, tokens: int, loss: int) -> int:
    """The longest piece from start on that keeps to the room for tokens and loss-bearing tokens."""
    return min(tokens, max(0, prompt - start) + loss)


def place(lengths, prompts, max_tokens: int, max_segments: int, max_loss: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of pieces (example, start, length) that cover every token once.

    lengths: tokens of each example; prompts: how many of its first tokens bear no loss.
    """
    lengths, prompts = np.asarray(lengths, dtype=np.int64), np.asarray(prompts, dtype=np.int64)
    done: list[list[tuple[int, int, int]]] = []
    starts = np.zeros(len(lengths), dtype=np.int64)
    for i in np.nonzero(lengths >= max_tokens)[0]:  # whole sequences of one long example
        while lengths[i] - starts[i] >= max_tokens and (n := _fit(starts[i], prompts[i], max_tokens, max_loss)) == max_tokens:
            done.append([(int(i), int(starts[i]), n)])
            starts[i] += n
    left = lengths - starts
    loss = left - np.clip(prompts - starts, 0, left)
    waiting = left > 0
    tail: list[tuple[int, int, int]] = []
    n_waiting = int(waiting.sum())
    while n_waiting:
        room, segments, room_loss, pieces = max_tokens, max_segments, max_loss, []
        while room and segments and n_waiting:
            product = left * (room / max_tokens**2) + segments / max_segments**2 + loss * (room_loss / max_loss**2)
            fits = waiting & (left <= room) & (loss <= room_loss)
            if fits.any():
                i = int(np.argmax(np.where(fits, product, -1.0)))
                n = int(left[i])
            else:
                i = int(np.argmax(np.where(waiting, product, -1.0)))
                n = int(min(left[i], _fit(int(starts[i]), int(prompts[i]), room, room_loss)))
                if not n:
                    break
            borne = n - min(n, max(0, int(prompts[i] - starts[i])))
            pieces.append((i, int(starts[i]), n))
            starts[i] += n
            left[i] -= n
            loss[i] -= borne
            room, segments, room_loss = room - n, segments - 1, room_loss - borne
            if not left[i]:
                waiting[i] = False
                n_waiting -= 1
        if room and not n_waiting:
            tail = pieces
        else:
            done.append(pieces)
    size = 1 << max_tokens.bit_length()
    total = sum(n for _, _, n in tail)
    while tail:  # the binary digits of what is left, largest first
        while size > total:
            size //= 2
        room, pieces = size, []
        while room:
            i, s, n = tail.pop(0)
            k = min(n, room)
            pieces.append((i, s, k))
            if k < n:
                tail.insert(0, (i, s + k, n - k))
            room -= k
        done.append(pieces)
        total -= size
    return done


def pack(
    df: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    max_tokens: int = 4096,
    max_segments: int = 256,
    max_loss: int = 4096,
    block_rows: int = 2048,
    block_tokens: int = 4_000_000,
    keep_ids: bool = True,
) -> DataFrame:
    """Pack the examples of a table; one row per piece, with its ids where keep_ids is set.

    An example is the prompt (no loss on it), then the text, then end_id. sequence_id is unique over
    the table: the partition's number in the high bits, a count within it in the low 40.
    """
    columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")]
    columns.append((F.coalesce(F.col(f"`{prompt_col}`").cast("string"), F.lit("")) if prompt_col else F.lit("")).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        docs, ids, prompts, held = [], [], [], 0

        def flush():
            nonlocal sequence
            out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset", "sequence_tokens", "ids")}
            for pieces in place([len(x) for x in ids], prompts, max_tokens, max_segments, max_loss):
                offset, total = 0, sum(n for _, _, n in pieces)
                for i, s, n in pieces:
                    raw = ids[i][s : s + n].astype("<u4").tobytes()
                    row = (docs[i], s, n, zlib.crc32(raw), len(ids[i]), n - min(n, max(0, prompts[i] - s)), sequence, offset, total, raw if keep_ids else None)
                    for column, value in zip(out.values(), row):
                        column.append(value)
                    offset += n
                sequence += 1
            kinds = [pa.int64()] * 9 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

        for batch in batches:
            bodies = enc.encode_many((x.as_py() for x in batch.column(1)), end_id)
            for doc, prompt, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), bodies):
                head = enc.encode_ids(prompt) if prompt else None
                docs.append(doc)
                prompts.append(0 if head is None else len(head))
                ids.append(body if head is None else np.concatenate([head, body]))
                held += len(ids[-1])
                if len(ids) >= block_rows or held >= block_tokens:
                    yield flush()
                    docs, ids, prompts, held = [], [], [], 0
        if ids:
            yield flush()

    return df.select(*columns).mapInArrow(run, SCHEMA)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, tokenizer_path("word_bpe_49k.json"), 2, keep_ids=False).drop("ids")
