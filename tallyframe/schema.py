"""Row types.  Sizes are DECIMAL(20,0) where they are parsed, since they may need all of 64 bits."""

from __future__ import annotations

from pyspark.sql import types as T

SIZE = T.DecimalType(20, 0)
ENTRY = T.StructType([T.StructField("line_no", T.LongType(), False), T.StructField("path", T.StringType(), False), T.StructField("size", SIZE, False), T.StructField("md5", T.BinaryType(), False)])
TREE = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("raw_path", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("target_kind", T.StringType(), False), T.StructField("size", T.LongType(), False)])
MEMBER = T.StructType([T.StructField(n, t, False) for n, t in (("ordinal", T.LongType()), ("path", T.StringType()), ("method", T.IntegerType()), ("crc32", T.LongType()), ("compressed_size", T.LongType()), ("uncompressed_size", T.LongType()), ("header_offset", T.LongType()))])


class ManifestError(ValueError):
    """A manifest, archive or install that the engine refuses; kind is the stable name of the reason."""

    def __init__(self, kind: str, detail: str = "") -> None:
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail = kind, detail

    def __reduce__(self):
        return type(self), (self.kind, self.detail)
