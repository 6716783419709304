"""License scans by diagonal voting.

Every rolling k-gram hash of a document meets the positions of the same k-gram in the license templates; a licensed
passage shows as many matches on one offset diagonal. Neighbouring diagonals (words added or lost in between) merge, and
a merged span counts if it covers enough of its template. Named phrases are found exactly and always count.

Edge cases: a null or empty text has no words, no places (first_word and last_word null), empty labels and score 0;
repeated rows each get a row; ties between templates of one label keep the best; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, row_key, text_of, words

# Phrases that name a license, and the label of each.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The wording of common license notices, by label.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
K = 3
#: Diagonals at most this far apart belong to one passage.
NEAR = 3
#: Share of a template's k-grams that a passage must hold.
COVER = 0.5


def template_grams(spark, k: int = K) -> DataFrame:
    """All k-grams of the templates, a few hundred rows fixed by this file."""
    rows = [(t, label, len(w) - k + 1, p, " ".join(w[p : p + k])) for t, (label, text) in enumerate(TEMPLATES) for w in [text.split()] for p in range(len(w) - k + 1)]
    df = spark.createDataFrame(rows, "t_id int, t_label string, t_size int, t_pos int, t_words string")
    return df.withColumn("hash", F.xxhash64(*[F.xxhash64(F.get(F.split("t_words", " "), F.lit(i))) for i in range(k)]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, end, score).

    One scan; the templates are a broadcast of fixed size; what is shuffled is a row per document and per match. Groups
    are single documents.
    """
    norm = F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))
    named = r" (?:" + "|".join(PHRASES) + r")(?= )"
    base = docs.select(F.col(id_col).alias("_id"), row_key(text_of(text_col)).alias("_key"), words(text_of(text_col)).alias("_w")).withColumn("_norm", norm)
    # pieces between phrases tell how many words stand before each: every word has one blank before it
    base = base.withColumns({"_hits": F.transform(F.regexp_extract_all("_norm", F.lit(named), F.lit(0)), lambda x: F.ltrim(x)), "_gaps": F.when(F.col("_norm").rlike(named), F.split("_norm", named, -1)).otherwise(F.array(F.lit("")))})
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    n_hits = F.size("_hits")
    last_words = F.size(F.split(F.get("_hits", n_hits - 1), " "))
    base = base.select(
        "_id",
        "_key",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        n_hits.cast("long").alias("n_base"),
        F.when(n_hits > 0, blanks(F.get("_gaps", F.lit(0)))).cast("long").alias("first_word"),
        # the text ends in a blank, so the last gap has one blank more than words
        F.when(n_hits > 0, F.size("_w") - (blanks(F.get("_gaps", n_hits)) - 1) - last_words).cast("long").alias("last_word"),
        F.array_distinct(F.transform("_hits", lambda x: _label(x))).alias("_base"),
    )
    size = F.size("_w")
    at = F.when(size >= k, F.sequence(F.lit(0), size - k)).otherwise(F.array().cast("array<int>"))
    templates = template_grams(docs.sparkSession, k)
    known = [r["hash"] for r in templates.select("hash").distinct().collect()]  # a few hundred, fixed by this file
    rolling = lambda h: F.transform(at, lambda i: F.struct(i.alias("pos"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")))
    # only grams that some template has become rows
    hits = let(F.transform("_w", lambda w: F.xxhash64(w)), lambda h: F.filter(rolling(h), lambda x: x["hash"].isin(known)))
    grams = F.concat(F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("hash"))), hits)
    rolled = base.select("*", F.explode_outer(grams).alias("x")).select(*base.columns, F.col("x.pos").alias("pos"), F.col("x.hash").alias("hash"))
    met = rolled.join(F.broadcast(templates), "hash", "left").filter((F.col("pos") < 0) | (F.array_join(F.slice("_w", F.col("pos") + 1, k), " ") == F.col("t_words")))
    # votes of each diagonal; the document's own row has no template
    facts = ["n_words", "n_base", "first_word", "last_word", "_base"]
    votes = met.groupBy("_id", "_key", "t_id", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        *[F.first(c).alias(c) for c in facts], F.first("t_label").alias("t_label"), F.first("t_size").alias("t_size"), F.collect_set("t_pos").alias("places"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count(F.lit(1)).alias("times")
    )
    by = W.partitionBy("_id", "_key", "t_id").orderBy("diagonal")
    merged = votes.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= near, 0).otherwise(1)).withColumn("passage", F.sum("new").over(by))
    spans = merged.groupBy("_id", "_key", "t_id", "passage").agg(
        *[F.first(c).alias(c) for c in facts], F.first("t_label").alias("t_label"), F.max("times").alias("times"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.size(F.array_distinct(F.flatten(F.collect_list("places")))) / F.first("t_size")).alias("share")
    )
    span = F.when(F.col("t_id").isNotNull() & (F.col("share") >= cover), F.struct(F.col("t_label").alias("label"), F.col("lo").alias("start"), (F.col("hi") + k).alias("end"), F.col("share").alias("score")))
    out = spans.groupBy("_id", "_key").agg(*[F.first(c).alias(c) for c in facts], F.collect_set(span).alias("spans"), F.max(F.when(F.col("t_id").isNull(), F.col("times"))).alias("times"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", F.transform("spans", lambda s: s["label"]))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))).alias("score"),
        F.array_sort("spans").alias("spans"),
    )


def _label(phrase):
    out = F.lit(None).cast("string")
    for words_, label in PHRASES.items():
        out = F.when(phrase == words_, F.lit(label)).otherwise(out)
    return out
