"""Media columns: bytes stored as progressive JPEG, and read back into RGB tensors.

``store_media`` cuts a payload into blocks of 64 bytes; a byte, less 128, is one quantised
coefficient, the JPEG's own unit, so that nothing is lost.  ``read_media`` accumulates the
scans of a file into coefficient arrays, transforms them back, brings chroma to full
resolution and gives the tensor (``jpeg`` has both).  It takes other progressive and
baseline files too, then without a payload.

Cases: a null text counts as empty and has a payload of 64 zero bytes; equal texts have
equal files; repeated rows and null ids are kept, one result for each input row; other
columns are ignored by ``store_media``, whatever their names, and kept by ``read_media`` but for
those named like its results; a worker holds some twenty times a text's bytes at a time, one
text if it is longer than BYTES; an empty table gives an empty table; media that
is null has null results; a file that isn't a whole JPEG raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, jpeg

NOTE = b"payload="
#: Rows and bytes that a worker has in hand at a time.
ROWS, BYTES = 256, 1 << 20


def payload_blocks(data: bytes) -> np.ndarray:
    """Zero bytes up to a positive multiple of 64, as blocks of coefficients."""
    n = max(1, -(-len(data) // 64))
    return (np.frombuffer(data.ljust(64 * n, b"\0"), np.uint8).astype(np.int64) - 128).reshape(n, 64)


def payload_of(im: jpeg.Image, coefs: np.ndarray) -> bytes | None:
    note = next((c for c in im.comments if c.startswith(NOTE)), None)
    if note is None:
        return None
    own = [coefs[c.first : c.first + c.padded * c.rows] for c in im.components]
    return (np.concatenate(own)[: int(note[len(NOTE) :]) // 64] + 128).astype(np.uint8).tobytes()


def store_media(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each row: the column's bytes (of a string: UTF-8) as a
    progressive JPEG."""
    slim = docs.select(docs[id_col].alias("id"), F.coalesce(docs[data_col].cast("binary"), F.lit(b"")).alias("data"))

    def run(batches):
        for b in common.slices(batches, ROWS, BYTES):
            data = b.column(1).to_pylist()
            blocks = [payload_blocks(x) for x in data]
            files = jpeg.encode(blocks, [NOTE + str(64 * len(x)).encode() for x in blocks])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, data)), pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])

    return common.spread(slim).mapInArrow(run, T.StructType([common.field(docs, id_col)]).add("n_bytes", "long").add("media", "binary"))


def read_media(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns, and height, width, rgb (height x width x 3 bytes), means of the three
    channels and the payload, in place of columns that have these names."""
    new = T.StructType().add("height", "integer").add("width", "integer").add("rgb", "binary").add("means", T.ArrayType(T.DoubleType())).add("payload", "binary")
    types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.binary()]

    kept = [f for f in stored.schema.fields if f.name not in new.names]

    def run(batches):
        for b in common.slices(batches, ROWS, 2 * BYTES):
            files = b.column(b.schema.get_field_index(media_col)).to_pylist()
            at = [i for i, x in enumerate(files) if x is not None]
            images, coefs = jpeg.decode([files[i] for i in at])
            rows: list = [(None,) * 5] * len(files)
            for i, im in zip(at, images, strict=True):
                t = jpeg.rgb(im, coefs)
                rows[i] = (im.height, im.width, t.tobytes(), [float(x) for x in np.round(t.mean((0, 1), np.float64), 6)], payload_of(im, coefs))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in kept), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], [*(f.name for f in kept), *new.names])

    return stored.mapInArrow(run, T.StructType([*kept, *new.fields]))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, stored and read back."""
    got = read_media(store_media(common.table(spark, sf_dir, "documents")))
    means = [F.format_string("%.6f", F.col("means")[i]) for i in range(3)]
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.concat_ws("x", "height", "width", F.lit(3)), F.concat_ws(",", *means), F.sha2("rgb", 256)).alias("feature"),
    )


def queries() -> dict:
    return {"op1_media": op1_media}
