"""Plug-in scorers and payload encoders, run once per Python worker over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.functions.vectors import round_score

# A scorer is made once per task; it takes payload bytes of one batch and returns a list with
# (aesthetic, nsfw) or None for a payload it cannot read.
Scorer = Callable[[list[bytes]], list[tuple[float, float] | None]]
Encoder = Callable[[bytes], bytes]


def batch_score(
    df: DataFrame, make_scorer: Callable[[], Scorer], content: str = "content", batch_size: int = 64
) -> DataFrame:
    """(id, laion_aesthetic, nsfw_prob, readable); unreadable rows have null scores."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                results = scorer(part.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([r[0] if r else None for r in results], pa.float64()),
                        pa.array([r[1] if r else None for r in results], pa.float64()),
                        pa.array([r is not None for r in results], pa.bool_()),
                    ],
                    ["id", "laion_aesthetic", "nsfw_prob", "readable"],
                )

    scored = df.select(F.col("id").cast("string"), F.col(content).alias("content")).mapInArrow(
        score, "id string, laion_aesthetic double, nsfw_prob double, readable boolean"
    )
    return scored.withColumns(
        {
            "laion_aesthetic": round_score(F.col("laion_aesthetic"), 4),
            "nsfw_prob": round_score(F.col("nsfw_prob"), 5),
        }
    )


def split_scored(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The score rows, and the ids of the unreadable payloads."""
    return (
        scored.filter("readable").drop("readable"),
        scored.filter("NOT readable").select("id"),
    )


def payload_transform(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    make_decoder: Callable[[], Encoder],
    suffix: str,
    content: str = "content",
) -> DataFrame:
    """(id, image{bytes, path}, bytes_in, bytes_out, lossless) of re-encoded payloads."""
    image = "struct<bytes:binary,path:string>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = make_encoder(), make_decoder()
        for batch in batches:
            encoded, back = [], []
            for data in batch.column("content").to_pylist():
                out = None if data is None else encoder(data)
                encoded.append(out)
                back.append(out is not None and decoder(out) == data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("bytes_in"),
                    pa.array(encoded, pa.binary()),
                    pa.array(back, pa.bool_()),
                ],
                ["id", "bytes_in", "encoded", "lossless"],
            )

    rows = df.select(
        F.col("id").cast("string"),
        F.octet_length(content).cast("bigint").alias("bytes_in"),
        F.col(content).cast("binary").alias("content"),
    ).mapInArrow(encode, "id string, bytes_in bigint, encoded binary, lossless boolean")
    return rows.select(
        "id",
        F.struct(
            F.col("encoded").alias("bytes"), F.concat("id", F.lit(suffix)).alias("path")
        ).cast(image).alias("image"),
        "bytes_in",
        F.octet_length("encoded").cast("bigint").alias("bytes_out"),
        "lossless",
    )
