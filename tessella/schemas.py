"""Declared schemas of what the engine writes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

#: One cataloged image.
CATALOG_IMAGE = _struct(
    source_id=_S, source_member=_S, file_name=_S, byte_size=_L, source_signature=_S, image_id=_S, objective_lens=_I, case_id=_S, patient_id=_S, slide_group_id=_S,
    raw_glade=_S, grade_semantics=_S, case_label=_I, label_level=_S, label_source=_S, identity_status=_S,
)
#: The same in a shard's manifest.
MANIFEST_IMAGE = T.StructType([*CATALOG_IMAGE.fields, T.StructField("member", _S), T.StructField("sha256", _S)])
#: A quality row of one image.
QUALITY = _struct(
    image_id=_S, source_sha256=_S, duplicate_source_content=_B, duplicate_source_image_ids=T.ArrayType(_S), background_reference_rgb=T.ArrayType(_D), width=_I, height=_I,
    decode_ok=_B, tissue_fraction=_D, focus_score=_D, tiles_eligible=_I, tiles_written=_I, status=_S, reasons=T.ArrayType(_S),
)
