"""Explicit schemas, so no reader has to infer one."""

from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("text", T.StringType()),
])

TRANSCRIPT = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("segments", T.ArrayType(SEGMENT)),
])

SCORES = T.MapType(T.StringType(), T.DoubleType())

MODELS = ("toxic", "hate", "offensive", "sentiment", "target")

MODEL_OUTPUTS = T.StructType([T.StructField(m, SCORES) for m in MODELS])

ERROR = T.StructType([
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
])

STATISTICS = T.StructType([
    T.StructField("language", T.StringType()),
    T.StructField("total_segments", T.LongType()),
    T.StructField("toxic_segments", T.LongType()),
    T.StructField("avg_toxicity", T.DoubleType()),
    T.StructField("max_toxicity", T.DoubleType()),
    T.StructField("extremist_segments", T.LongType()),
    T.StructField("avg_extremist_probability", T.DoubleType()),
    T.StructField("max_extremist_probability", T.DoubleType()),
    T.StructField("extremist_ratio", T.DoubleType()),
    T.StructField("weighted_extremist_score", T.DoubleType()),
])

RESULT = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("result", T.StringType()),
    T.StructField("isExtremist", T.BooleanType()),
    T.StructField("segments", T.ArrayType(T.StructType([
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("startTime", T.DoubleType()),
        T.StructField("endTime", T.DoubleType()),
        T.StructField("extreme", T.DoubleType()),
        T.StructField("emotion", T.StringType()),
        T.StructField("emotionScore", T.DoubleType()),
        T.StructField("hateTarget", T.StringType()),
        T.StructField("hateTargetConfidence", T.DoubleType()),
    ]))),
    T.StructField("part", T.LongType()),
    T.StructField("statistics", STATISTICS),
    T.StructField("full_text_classification", T.StructType([
        T.StructField("overall_toxicity", T.DoubleType()),
        T.StructField("is_toxic", T.BooleanType()),
    ])),
    T.StructField("filename", T.StringType()),
])
