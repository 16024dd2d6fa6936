"""Table schemas."""

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


INTERNAL_REF = _struct(clause_id=S, chunk_id=S)
EXTERNAL_REF = _struct(kind=S, clause_id=S, raw_text=S, chunk_id=S, standard=S, title=S)
IMAGE_REF = _struct(image_id=S, filename=S, caption=S, described=B)

CHUNK_FILE = _struct(
    id=S, node_type=S, clause_id=S, hierarchy=T.ArrayType(S), heading=S, doc=S, text=S,
    defined_terms=T.ArrayType(S), cross_refs=T.ArrayType(S), internal_refs=T.ArrayType(INTERNAL_REF),
    image_refs=T.ArrayType(IMAGE_REF), external_refs=T.ArrayType(EXTERNAL_REF),
    building_classes=T.ArrayType(S), jurisdictions=T.ArrayType(S), climate_zones=T.ArrayType(I),
    applicability_note=S, embedding=T.ArrayType(T.FloatType()),
)

NODES = _struct(
    corpus=S, publishing_id=S, node_id=S, pre=L, last=L, parent=L, ord=I, tag_ord=I, depth=I, tag=S,
    attrs=T.MapType(S, S), text=S, tail=S, tag_path=T.ArrayType(S), pre_path=T.ArrayType(L), nth_path=T.ArrayType(I),
)

DESCRIPTION = _struct(image=S, file_name=S, description=S, model=S, prompt_version=S, chars=L, described_at=S)
DESCRIPTION_ERROR = _struct(image=S, file_name=S, error=S, attempts=I, failed_at=S)
VECTOR_LOG = _struct(id=S, embedding=T.ArrayType(T.DoubleType()))
FEEDBACK = _struct(
    id=S, clause_id=S, doc=S, query=S, reported_status=S, corrected_status=S, comment=S, created_at=T.TimestampType(),
)
