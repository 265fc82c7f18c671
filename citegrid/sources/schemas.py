"""Explicit schemas of the input and output tables."""

from pyspark.sql import types as T

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()


def table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


WORKS = table(openalex_id=STRING, id=LONG)
CITATIONS = table(citing_id=LONG, cited_id=LONG)
TEXT_CITATIONS = table(citing_id=STRING, cited_id=STRING)
CORE_WORKS = table(openalex_work_id=STRING)
DOIS = table(doi=STRING)
TITLES = table(Title=STRING, DOI=STRING)
RECORDS = table(id=STRING, referenced_works=STRING)
EDGES = table(source=LONG, target=LONG, weight=LONG, type=STRING)
AFFILIATIONS = table(
    institution_id=STRING, institution_display_name=STRING, institution_country_code=STRING)
ISO_CODES = T.StructType([
    T.StructField("A2_code", STRING), T.StructField("A3_code", STRING), T.StructField("ISO 3166", STRING)])

_NAMED = T.StructType([T.StructField("display_name", STRING), T.StructField("ror", STRING)])
METADATA = T.StructType([
    T.StructField("id", STRING), T.StructField("doi", STRING), T.StructField("title", STRING),
    T.StructField("ids", T.StructType([T.StructField("openalex", STRING), T.StructField("mag", STRING)])),
    T.StructField("best_oa_location", T.StructType([
        T.StructField("is_oa", T.BooleanType()), T.StructField("license", STRING),
        T.StructField("pdf_url", STRING)])),
    T.StructField("authorships", T.ArrayType(T.StructType([
        T.StructField("author", T.StructType([T.StructField("display_name", STRING)])),
        T.StructField("institutions", T.ArrayType(_NAMED))]))),
    T.StructField("abstract_inverted_index", T.MapType(STRING, T.ArrayType(INT))),
])
LABELS = T.StructType([
    T.StructField("id", STRING),
    T.StructField("keywords", T.ArrayType(T.StructType([
        T.StructField("id", STRING), T.StructField("display_name", STRING),
        T.StructField("score", T.DoubleType())]))),
    T.StructField("sustainable_development_goals", T.ArrayType(T.StructType([
        T.StructField("id", STRING), T.StructField("display_name", STRING),
        T.StructField("score", T.DoubleType())]))),
])
