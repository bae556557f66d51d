"""Documents that arrive as chunks of bytes.

A chunk is ``(doc_id, seq, bytes, is_last)``.  However a document is cut --
also inside a character -- its nodes are the same.  The state of a document is
the chunks received so far by number, so chunks may come out of order and
twice; it ends when all up to the last are there, or, if one is given, by a
processing-time timeout, when what is there is parsed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import NODES, flatten
from ..operators.documents import in_batches
from ..operators.stage import gathered

STATE = "parts map<int,binary>, last int"
NAMES = [c.split(" ")[0] for c in NODES.split(", ")]


def _rows(fmt: str, doc_id: int, body: bytes) -> list[tuple]:
    from ..sources.registry import BINARY, parse

    try:
        source = body if fmt in BINARY else body.decode("utf-8", "replace")
        return flatten(int(doc_id), parse(fmt, source).root)
    except Exception:  # a failed document has no nodes
        return []


def _parsed(fmt: str, doc_id: int, body: bytes) -> pd.DataFrame:
    out = pd.DataFrame(_rows(fmt, doc_id, body), columns=NAMES)
    for c in ("parent_id", "level"):
        out[c] = out[c].astype("Int32")
    return out


def split_chunks(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Cut texts into chunks of ``size`` bytes."""
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / size)).cast("int")
    # Only the cut parts are exploded, as every exploded row would hold the whole text beside its part.
    part = lambda k: F.struct(k.alias("seq"), F.substring(body, k * size + 1, F.lit(size)).alias("bytes"), (k == n - 1).alias("is_last"))
    return df.select(F.col(id_col).alias("doc_id"), F.explode(F.transform(F.sequence(F.lit(0), n - 1), part)).alias("c")).select("doc_id", "c.*")


def parse_chunks(chunks: DataFrame, fmt: str) -> DataFrame:
    """``nodes`` of a finished set of chunks; of repeated chunks one counts, the greatest."""
    whole = gathered(chunks.where("doc_id IS NOT NULL").select("doc_id", "seq", "bytes"), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parsed():
            doc, at, parts = None, None, []
            for batch in batches:
                for i, seq, body in zip(*batch.columns, strict=True):
                    i, seq, body = i.as_py(), seq.as_py(), body.as_py()
                    if i != doc:
                        if parts:
                            yield sum(map(len, parts)), _rows(fmt, doc, b"".join(parts))
                        doc, at, parts = i, seq, [body]
                    elif seq == at:
                        parts[-1] = max(parts[-1], body)
                    else:
                        at = seq
                        parts.append(body)
            if parts:
                yield 0, _rows(fmt, doc, b"".join(parts))

        yield from in_batches(parsed(), NODES)

    return whole.mapInArrow(run, NODES)


def parse_stream(chunks: DataFrame, fmt: str, timeout: str | None = None) -> DataFrame:
    """``nodes`` of a stream of chunks, each document once it is complete."""
    span = _milliseconds(timeout) if timeout else None

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, last = state.get if state.exists else ({}, -1)
        parts = {int(k): bytes(v) for k, v in dict(parts).items()}
        if not state.hasTimedOut:
            for pdf in batches:
                for seq, body, is_last in zip(pdf["seq"], pdf["bytes"], pdf["is_last"], strict=True):
                    parts[int(seq)] = bytes(body)
                    last = int(seq) if is_last else last
        if state.hasTimedOut or (last >= 0 and len(parts) > last):
            if state.exists:
                state.remove()
            yield _parsed(fmt, key[0], b"".join(parts[k] for k in sorted(parts)))
        else:
            state.update((parts, last))
            if span:
                state.setTimeoutDuration(span)

    return chunks.where("doc_id IS NOT NULL").groupBy("doc_id").applyInPandasWithState(
        run, NODES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if span else GroupStateTimeout.NoTimeout
    )


def _milliseconds(span: str) -> int:
    n, unit = span.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])
