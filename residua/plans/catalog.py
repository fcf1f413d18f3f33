"""Queries over the driver tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from residua import sinks
from residua.functions import sequences as fn
from residua.operators import embedding, metrics, sampling, scoring, similarity
from residua.scratch import scratch_path
from residua.sources import datasource, fasta, fasta_index, hits
from residua.streaming.fasta import score_stream, stream_fasta

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: A fixed linear model over the 21 composition features, for queries that score without training.
WEIGHTS = [round((k * 7 % 11 - 5) * 1.5, 2) for k in range(20)] + [0.05]
BIAS = -0.4


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cleaned() -> Column:
    return fn.clean_sequence(F.col("text"))


# SQL parts. The other engine's upper() leaves the sharp s.
CLEAN = "translate(text, 'Jj*', 'LL')"
SHARP = "upper(replace({}, 'ß', 'ss'))"
UPPER_CLEAN = SHARP.format(CLEAN)


def sql_count(upper: str, residue: str) -> str:
    return f"length({upper}) - length(replace({upper}, '{residue}', ''))"


def sql_features(upper: str) -> list[str]:
    n = f"length({upper})"
    return [*[f"CASE WHEN {n} > 0 THEN ({sql_count(upper, r)}) / {n}::DOUBLE ELSE 0 END" for r in fn.RESIDUES], f"{n} / 1000.0::DOUBLE"]


def sql_scored(upper: str) -> str:
    names = [*[f"aa_{r}" for r in fn.RESIDUES], "len_k"]
    feats = ", ".join(f"{e} AS {n}" for e, n in zip(sql_features("u"), names, strict=True))
    z = f"{BIAS}::DOUBLE" + "".join(f" + {n} * {w}::DOUBLE" for n, w in zip(names, WEIGHTS, strict=True))
    return f"SELECT *, {z} AS z FROM (SELECT *, {feats} FROM (SELECT *, {upper} AS u FROM documents))"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cleaned and scored, whole, with the fixed model."""
    feats = fn.with_composition(table(spark, sf_dir, "documents").select("doc_id", cleaned().alias("seq")), "seq")
    return feats.select("doc_id", scoring.linear_score([F.col(c) for c in fn.FEATURES], WEIGHTS, BIAS).alias("z"))


def predict_sql(probability: str) -> str:
    said = "CASE WHEN z > 0 THEN 'Adhesion' ELSE 'Non-adhesion' END AS prediction"
    return f"SELECT doc_id::VARCHAR AS id, {said}, {probability} AS probability_adhesion FROM ({sql_scored(UPPER_CLEAN)})"


PREDICT_SQL = predict_sql("round(1 / (1 + exp(-z)), 6)")


@query(PREDICT_SQL + " WHERE z > 0")
def predict_linear(spark, sf_dir):
    """Clean, composition, linear score, class name; positives only."""
    return rounded(scoring.predictions(scored(spark, sf_dir), "doc_id", "z"))


@query(PREDICT_SQL)
def predict_all(spark, sf_dir):
    return rounded(scoring.predictions(scored(spark, sf_dir), "doc_id", "z", show_all=True))


@query(predict_sql("printf('%.4f', 1 / (1 + exp(-z)))") + " WHERE z > 0")
def predictions_csv(spark, sf_dir):
    """The file of predictions as it is written, in order of id."""
    out = scratch_path(spark, sinks.prediction_name("documents.fasta", False))
    sinks.write_predictions(scoring.predictions(scored(spark, sf_dir), "doc_id", "z").orderBy("id"), out)
    return spark.read.option("header", True).csv(out)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("probability_adhesion", F.round("probability_adhesion", 6))


@query(f"SELECT doc_id, {CLEAN} AS sequence FROM documents")
def clean_sequence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaned().alias("sequence"))


@query(f"SELECT doc_id, substr({CLEAN}, 1, 1022) AS sequence FROM documents")
def truncate_1022(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.truncate(cleaned()).alias("sequence"))


@query(f"SELECT doc_id, length({SHARP.format('text')})::BIGINT AS n FROM documents")
def seq_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.seq_length(F.col("text")).alias("n"))


COUNTS_SQL = ", ".join(f"({sql_count('u', r)})::BIGINT AS n_{r}" for r in fn.RESIDUES)


@query(f"SELECT doc_id, {COUNTS_SQL} FROM (SELECT doc_id, {UPPER_CLEAN} AS u FROM documents)")
def aa_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", cleaned().alias("seq"))
    return fn.with_residue_counts(docs, "seq").drop("seq")


ROUNDED_SQL = ", ".join(f"round({e}, 9) AS {n}" for e, n in zip(sql_features("u"), fn.FEATURES, strict=True))


@query(f"SELECT doc_id, {ROUNDED_SQL} FROM (SELECT doc_id, {SHARP.format('text')} AS u FROM documents)")
def aa_frequencies(spark, sf_dir):
    """Of the text as it is: a raw J counts for the length only."""
    rows = fn.with_composition(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", *[F.round(c, 9).alias(c) for c in fn.FEATURES])


@query("""
SELECT event_id, printf('%.4f', value) AS shown, printf('%.4f', event_id % 4097 / 4096.0::DOUBLE) AS exact_half, printf('%.4f', (2 * (event_id % 10000) + 1) / 20000.0::DOUBLE) AS near_half
FROM events
""")
def format_prob(spark, sf_dir):
    """Any values, exact halves of the last digit, and doubles next to such halves."""
    e = F.col("event_id")
    shown = {"shown": F.col("value"), "exact_half": e % 4097 / F.lit(4096.0), "near_half": (2 * (e % 10000) + 1) / F.lit(20000.0)}
    return table(spark, sf_dir, "events").select("event_id", *(fn.format_probability(p).alias(n) for n, p in shown.items()))


@query("""
SELECT p_partkey, model, (CASE model WHEN 't6_8M' THEN least(greatest(p_size // 2, 4), 32) WHEN 't12_35M' THEN least(greatest(p_size // 4, 2), 16)
ELSE least(greatest(p_size // 3, 2), 8) END)::BIGINT AS batch
FROM (SELECT p_partkey, p_size, CASE p_partkey % 3 WHEN 0 THEN 't6_8M' WHEN 1 THEN 't12_35M' ELSE 'other' END AS model FROM part)
""")
def batch_size_rule(spark, sf_dir):
    kind = F.col("p_partkey") % 3
    model = F.when(kind == 0, "t6_8M").when(kind == 1, "t12_35M").otherwise("other")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", model.alias("model"))
    return parts.select("p_partkey", "model", fn.batch_size_rule(F.col("p_size"), F.col("model")).alias("batch"))


def as_record(id_: Column, text: Column) -> Column:
    return fasta.format_record(id_, F.col("source"), text)


@query("SELECT doc_id, '>d' || doc_id || ' ' || source || chr(10) || text AS record FROM documents")
def fasta_format(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", as_record(F.concat(F.lit("d"), "doc_id"), F.col("text")).alias("record"))


#: Documents in a file that a query writes.
FILE_DOCS = 5000


def fasta_files(spark: SparkSession, sf_dir: str, id_: Column, text: Column) -> str:
    """Writes the documents as FASTA files of ``FILE_DOCS``, in order of doc_id, below folders f=0, f=1, ..; where they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / FILE_DOCS).alias("f"), as_record(id_, text).alias("value"))
    path = scratch_path(spark, "fasta")
    docs.repartition("f").sortWithinPartitions("f", "doc_id").select("value", "f").write.partitionBy("f").text(path)
    return path


FILE_NO = r"/f=(\d+)/"


@query(f"""
SELECT doc_id // {FILE_DOCS} AS f, row_number() OVER (PARTITION BY doc_id // {FILE_DOCS} ORDER BY doc_id) AS record_no, 'd' || doc_id AS id, source AS description,
translate(text, 'Jj*> ' || chr(10) || chr(13) || chr(9), 'LL') AS sequence FROM documents
""")
def fasta_parse(spark, sf_dir):
    """Documents written as files and read back; a text's own marks would open records and are left out."""
    path = fasta_files(spark, sf_dir, F.concat(F.lit("d"), "doc_id"), F.translate("text", ">", ""))
    rows = fasta.read_fasta(spark, path, glob="*.txt")
    return rows.select(F.regexp_extract("file_path", FILE_NO, 1).cast("bigint").alias("f"), "record_no", "id", "description", "sequence")


@query(SQL["fasta_parse"])
def fasta_source(spark, sf_dir):
    """The same files through the data source."""
    path = fasta_files(spark, sf_dir, F.concat(F.lit("d"), "doc_id"), F.translate("text", ">", ""))
    rows = datasource.read_fasta(spark, path, suffixes=".txt")
    return rows.select(F.regexp_extract("file_path", FILE_NO, 1).cast("bigint").alias("f"), "record_no", "id", "description", "sequence")


@query(f"""
SELECT f, row_number() OVER (PARTITION BY f ORDER BY least_doc) AS ord, id
FROM (SELECT doc_id // {FILE_DOCS} AS f, lang || (doc_id % 97) AS id, min(doc_id) AS least_doc FROM documents GROUP BY 1, 2)
""")
def fasta_ids_distinct(spark, sf_dir):
    """Ids of the headers of written files, the first of equal ones of a file."""
    path = fasta_files(spark, sf_dir, F.concat("lang", (F.col("doc_id") % 97).cast("string")), F.lit("ACD"))
    rows = fasta.read_headers(spark, path, "*.txt")
    return rows.select(F.regexp_extract("file_path", FILE_NO, 1).cast("bigint").alias("f"), "ord", "id")


SUFFIXES = (".fasta", ".FAA", ".pep.gz", ".fas")


def suffixed_files(spark: SparkSession, sf_dir: str) -> str:
    """The documents in files of four suffixes by doc_id, one of them that of no sequence file, each in a folder of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("id"), F.col("lang").alias("description"), F.translate("text", ">\n\r", "").alias("sequence"))
    root = scratch_path(spark, "suffixes")
    for k, suffix in enumerate(SUFFIXES):
        sinks.write_fasta(docs.filter(F.col("doc_id") % len(SUFFIXES) == k), f"{root}/k{k}", suffix)
    return root


BODY = "translate(text, 'Jj*> ' || chr(10) || chr(13) || chr(9), 'LL')"


@query(f"SELECT (doc_id % 4)::INT AS k, 'd' || doc_id AS id, lang AS description, {BODY} AS sequence FROM documents WHERE doc_id % 4 < 3")
def fasta_discovery(spark, sf_dir):
    """All files below a folder by their suffixes, in any case, plain and gzip."""
    rows = fasta.read_fasta(spark, suffixed_files(spark, sf_dir))
    return rows.select(F.regexp_extract("file_path", r"/k(\d)/", 1).cast("int").alias("k"), "id", "description", "sequence")


@query(f"SELECT row_number() OVER (ORDER BY doc_id) AS record_no, 'd' || doc_id AS id, lang AS description, {BODY} AS sequence FROM documents")
def fasta_block_gzip(spark, sf_dir):
    """All documents in one block-gzip file, written in parts and read in ranges of a megabyte."""
    datasource.register(spark)
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("lang").alias("description"), F.translate("text", ">", "").alias("sequence"))
    root = scratch_path(spark, "blocks")
    docs.write.format("fasta").option("compression", "blocks").mode("append").save(f"{root}/parts")
    sinks.join_parts(spark, f"{root}/parts", "", f"{root}/one.fa.gz")
    return datasource.read_fasta(spark, f"{root}/one.fa.gz", splitBytes=1 << 20).drop("file_path")


#: What a folded record may hold here: visible ASCII, so that letters are bytes.
PLAIN = r"[^\x21-\x7E]|>"


@query(f"""
WITH d AS (SELECT doc_id, regexp_replace(text, '{PLAIN}', '', 'g') AS s FROM documents),
w AS (SELECT doc_id AS ord, 'd' || doc_id || ':' || (1 + doc_id % 50) || '-' || (100 + doc_id % 90) AS id, substr(s, 1 + doc_id % 50, 100 + doc_id % 90 - doc_id % 50) AS s FROM d JOIN labels USING (doc_id)
UNION ALL SELECT doc_id + 1000000000, 'd' || doc_id, s FROM d JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT ord, id, translate(s, 'Jj*', 'LL') AS sequence FROM w
""")
def fetch_regions(spark, sf_dir):
    """Regions and whole records by an index of byte offsets, from files with lines of 60 letters."""
    root = scratch_path(spark, "folded")
    folded = F.regexp_replace(F.regexp_replace("text", PLAIN, ""), "(.{60})", "$1\n")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("").alias("description"), folded.alias("sequence"))
    sinks.write_fasta(docs, f"{root}/files")
    fasta_index.save(fasta_index.build(spark, f"{root}/files"), f"{root}/index")
    e, name = F.col("doc_id"), F.concat(F.lit("d"), "doc_id")
    labels = table(spark, sf_dir, "labels")
    parts = labels.select(e.alias("ord"), F.concat(name, F.lit(":"), 1 + e % 50, F.lit("-"), 100 + e % 90).alias("id"))
    whole = labels.filter("toxic = 1").select((e + 1_000_000_000).alias("ord"), name.alias("id"))
    return fasta_index.fetch(spark.read.parquet(f"{root}/index"), parts.union(whole))


@query(f"SELECT 'd' || doc_id AS id, {BODY} AS sequence, (doc_id % 4 = 0)::INT AS label FROM documents WHERE doc_id % 4 IN (0, 2)")
def fasta_training(spark, sf_dir):
    """Positive and negative folders as training reads them: suffixes in lower case only."""
    root = suffixed_files(spark, sf_dir)
    sides = [fasta.read_fasta(spark, p, upper=False, on_error="fail") for p in ([f"{root}/k0", f"{root}/k1"], [f"{root}/k2", f"{root}/k3"])]
    return fasta.labelled_union(*sides).select("id", "sequence", "label")


@query(f"SELECT 'd' || doc_id AS id, round(length({SHARP.format(BODY)}) / 1000.0::DOUBLE, 6) AS len_k FROM documents WHERE doc_id % 4 < 3")
def fasta_stream(spark, sf_dir):
    """The same files as a stream, scored as they come."""
    out, marks = scratch_path(spark, "stream"), scratch_path(spark, "marks")
    score = lambda df: fn.with_composition(df.select("id", "sequence"), "sequence").select("id", F.round("len_k", 6).alias("len_k"))
    score_stream(stream_fasta(spark, suffixed_files(spark, sf_dir)), score, out, marks).awaitTermination()
    return spark.read.schema("id string, len_k double").parquet(out)


@query("""
WITH w AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id DESC))::BIGINT AS ord FROM labels UNION ALL SELECT doc_id, doc_id + 1000000000 FROM labels WHERE toxic = 1)
SELECT ord, doc_id AS id, source FROM w JOIN documents USING (doc_id) ORDER BY ord
""")
def fetch_in_order(spark, sf_dir):
    """Records by a list of ids, in its order and with its repeats."""
    labels = table(spark, sf_dir, "labels")
    n = sampling.assign_batches(labels.select((-F.col("doc_id")).alias("down"), "doc_id"), "down", 1).select(F.col("doc_id").alias("id"), (F.col("batch") + 1).alias("ord"))
    again = labels.filter("toxic = 1").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1_000_000_000).alias("ord"))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return fasta.fetch(records, n.union(again)).select("ord", "id", "source")


#: For prose, where short words say nothing. An error costs what 18 letters bring: above 90 there is a run of 19, which has a seed.
PROSE = similarity.Search(k=12, window=8, strip=32, min_seeds=1, min_score=150, mismatch=-90, gap_open=90, gap_extend=90)
SF_SMALL = "/root/testdata/sf0.001"


@query()
def similarity_join(spark, sf_dir):
    """Local alignments of every fiftieth document with all. No SQL aligns: held to the whole matrix in the tests."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), cleaned().alias("sequence"), "doc_id")
    return similarity.similar(docs.filter("doc_id % 50 = 0"), docs, PROSE).drop("evalue", "bits")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def counts_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


#: Every so manyth line is odd in its way: blank, short, or with an identity that is no number or an unusual one.
ODD_LINES = 12
ODD = {0: "  ", 2: "nan", 3: "abc", 4: "9_5.5", 5: "9.55e1", 6: " 95.5", 7: "95.5d", 8: "", 9: "-inf", 10: "Infinity"}


def hit_lines(spark: SparkSession, sf_dir: str, which: Column | None = None) -> DataFrame:
    """Eleven-field lines from lineitem: query, subject, identity, fillers and e-value; some are malformed."""
    item = table(spark, sf_dir, "lineitem")
    item = item if which is None else item.filter(which)
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % ODD_LINES
    identity = (F.col("l_quantity") * 2).cast("decimal(5,1)").cast("string")
    for k, text in ODD.items():
        identity = F.when(kind == k, F.lit(text)).otherwise(identity) if k else identity
    evalue = F.when(kind == 11, F.concat(F.lit("1e-"), "l_linenumber")).otherwise(F.col("l_discount").cast("decimal(4,2)").cast("string"))
    fields = [F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), identity, *[F.lit("-")] * 7, evalue]
    whole = F.concat_ws("\t", *fields)
    line = F.when(kind == 0, ODD[0]).when(kind == 1, F.concat_ws("\t", *fields[:10])).when(kind == 6, F.concat(F.lit(" "), whole, F.lit("\t "))).otherwise(whole)
    return item.select(line.alias("value"))


ODD_SQL = " ".join(f"WHEN {k} THEN '{t}'" for k, t in ODD.items() if k)


def lines_sql(part: str = "") -> str:
    """The same lines in SQL; ``part`` names a column that stays beside them."""
    odd = f"CASE k {ODD_SQL} ELSE (l_quantity * 2)::DECIMAL(5,1)::VARCHAR END"
    evalue = "CASE k WHEN 11 THEN '1e-' || l_linenumber ELSE l_discount::DECIMAL(4,2)::VARCHAR END"
    fields = f"[l_orderkey::VARCHAR, l_partkey::VARCHAR, {odd}, '-', '-', '-', '-', '-', '-', '-', {evalue}]"
    whole = "array_to_string(f, chr(9))"
    line = f"CASE k WHEN 0 THEN '  ' WHEN 1 THEN array_to_string(f[1:10], chr(9)) WHEN 6 THEN ' ' || {whole} || chr(9) || ' ' ELSE {whole} END AS line"
    return f"(SELECT {part}{line} FROM (SELECT {part}k, {fields} AS f FROM (SELECT *, (l_orderkey % 3)::INT AS part, (l_orderkey + l_linenumber) % {ODD_LINES} AS k FROM lineitem)))"


def hits_sql(part: str = "") -> str:
    split = f"(SELECT {part}string_split(trim(line, ' ' || chr(9)), chr(9)) AS f FROM {lines_sql(part)})"
    numbers = f"(SELECT *, TRY_CAST(trim(f[3]) AS DOUBLE) AS p, TRY_CAST(f[11] AS DOUBLE) AS e FROM {split} WHERE len(f) >= 11)"
    return f"SELECT {part}f[1] AS query, f[2] AS subject, f[3] AS pident_raw, f[11] AS evalue_raw FROM {numbers} WHERE p IS NOT NULL"


LINES_SQL, HITS_SQL = lines_sql(), hits_sql()
ABOVE_SQL = " AND p > 90 AND NOT isnan(p)"
HIT_NAMES = ("query", "subject", "pident_raw", "evalue_raw")


@query(HITS_SQL + ABOVE_SQL)
def hits_parse_filter(spark, sf_dir):
    return hits.above_identity(hits.parse_hits(hit_lines(spark, sf_dir)), 90.0).select(*HIT_NAMES)


@query(HITS_SQL + " AND e <= 0.05")
def hits_evalue_filter(spark, sf_dir):
    return hits.within_evalue(hits.parse_hits(hit_lines(spark, sf_dir)), 0.05).select(*HIT_NAMES)


@query(f"SELECT DISTINCT subject FROM ({HITS_SQL}{ABOVE_SQL}) ORDER BY subject")
def hit_ids_sorted(spark, sf_dir):
    return hits.above_identity(hits.parse_hits(hit_lines(spark, sf_dir)), 90.0).select("subject").distinct().orderBy("subject")


@query(hits_sql("part, ") + ABOVE_SQL)
def hits_files(spark, sf_dir):
    """Lines written as three folders of files, read in that order, filtered, written and read again."""
    root = scratch_path(spark, "hits")
    for k in range(3):
        hit_lines(spark, sf_dir, F.col("l_orderkey") % 3 == k).write.text(f"{root}/{k}")
    kept = hits.above_identity(hits.judge_hits(hits.read_hit_lines(spark, [f"{root}/{k}" for k in range(3)])).filter("problem is null"), 90.0)
    parts = []
    for k in range(3):
        sinks.write_hits(kept.filter(F.col("file_no") == k), f"{root}/kept{k}")
        f = F.split("value", "\t", -1)
        parts.append(spark.read.text(f"{root}/kept{k}").select(F.lit(k).alias("part"), *(f[i].alias(n) for i, n in enumerate(HIT_NAMES))))
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""
SELECT coalesce(problem, 'none') AS problem, count(*) AS n
FROM (SELECT CASE WHEN len(f) = 1 AND f[1] = '' THEN 'blank' WHEN len(f) < 11 THEN 'short' WHEN TRY_CAST(trim(f[3]) AS DOUBLE) IS NULL THEN 'identity' END AS problem
FROM (SELECT string_split(trim(line, ' ' || chr(9)), chr(9)) AS f FROM {LINES_SQL})) GROUP BY 1
""")
def hits_skipped(spark, sf_dir):
    """Lines by what is wrong with them."""
    return hits.judge_hits(hit_lines(spark, sf_dir)).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT f[2] AS id FROM (SELECT string_split(trim(line, ' ' || chr(9)), chr(9)) AS f FROM {LINES_SQL}) WHERE len(f) >= 2 AND f[1][1] <> '#'")
def ignored_ids(spark, sf_dir):
    return hits.parse_ids(hit_lines(spark, sf_dir), 2)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.anti_join_ids(docs, table(spark, sf_dir, "labels"), "doc_id")


@query(f"SELECT doc_id, {CLEAN} AS sequence FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def subset_by_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", cleaned().alias("sequence"))
    return sampling.subset_by_ids(docs, table(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")


@query("SELECT doc_id, 1 AS label FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 0 FROM labels WHERE toxic = 0")
def labelled_union(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return fasta.labelled_union(rows.filter("toxic = 1").select("doc_id"), rows.filter("toxic = 0").select("doc_id"))


@query("SELECT vec_id, quality AS label, round(embedding[1]::DOUBLE, 6) AS first_dim FROM embeddings JOIN labels ON vec_id = doc_id")
def labelled_embeddings(spark, sf_dir):
    """Labels meet vectors by key, never by position."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_dim"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), F.col("quality").alias("label"))
    return vectors.join(labels, "vec_id").select("vec_id", "label", "first_dim")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5")
def sample_n_per_source(spark, sf_dir):
    return sampling.sample_per_source(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("SELECT source AS source_file, 'd' || doc_id AS id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:d' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 50")
def sampled_id_files(spark, sf_dir):
    """The lists of sampled ids as they are written, by source."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.concat(F.lit("d"), "doc_id").alias("id"))
    out = scratch_path(spark, "sampled")
    sinks.write_sampled_ids(sampling.sample_per_source(docs, "source_file", "id", 50), out)
    return spark.read.text(out).select("source_file", F.col("value").alias("id"))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 4 AS batch FROM documents")
def batch_assign(spark, sf_dir):
    return sampling.assign_batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4)


SPLIT_SQL = """
WITH n AS (SELECT quality, count(*) AS c FROM labels GROUP BY quality),
t AS (SELECT ceil(sum(c) * 0.2) AS want, sum(c) AS total FROM n),
q AS (SELECT quality, c * want / total AS exact, floor(c * want / total) AS base FROM n, t),
r AS (SELECT quality, base + CASE WHEN row_number() OVER (ORDER BY base - exact, quality) <= (SELECT want FROM t) - (SELECT sum(base) FROM q) THEN 1 ELSE 0 END AS quota FROM q),
k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY substr(md5('42:' || doc_id), 1, 15), doc_id) AS rn FROM labels)
SELECT doc_id, quality AS label, rn <= quota AS is_test FROM k JOIN r USING (quality)
"""


@query(SPLIT_SQL)
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return sampling.stratified_split(rows, "label", "doc_id", 0.2, 42).select("doc_id", "label", "is_test")


FOLDS_SQL = """
WITH g AS (SELECT quality, (row_number() OVER (ORDER BY quality, doc_id) - 1) % 5 AS f FROM labels),
s AS (SELECT quality, f, count(*) AS c FROM g GROUP BY quality, f),
e AS (SELECT quality, f, sum(c) OVER (PARTITION BY quality ORDER BY f) AS last FROM s),
k AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS rn FROM labels)
SELECT doc_id, k.quality AS label, min(f)::INT AS fold FROM k JOIN e ON k.quality = e.quality AND rn <= last GROUP BY doc_id, k.quality
"""


@query(FOLDS_SQL)
def stratified_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return sampling.stratified_folds(rows, "label", "doc_id", 5).select("doc_id", "label", "fold")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, a fixed score in steps of 1/1000 with ties, and a prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return rows.withColumn("prediction", (F.col("score") > 0.3).cast("int"))


JUDGED = "(SELECT doc_id, score, quality AS label, (score > 0.3)::INT AS prediction FROM (SELECT doc_id, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents) JOIN labels USING (doc_id))"
COUNTS = f"(SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM {JUDGED})"


@query(f"SELECT * FROM {COUNTS}")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(judged(spark, sf_dir))


REPORT_SQL = f"""
WITH m AS (SELECT * FROM {COUNTS}),
b AS (SELECT 'Non-adhesion' AS class, tn AS hit, tn + fn AS said, tn + fp AS support FROM m UNION ALL SELECT 'Adhesion', tp, tp + fp, tp + fn FROM m),
r AS (SELECT class, coalesce(hit::DOUBLE / nullif(said, 0), 0) AS precision, coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall, support FROM b),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r),
a AS (SELECT class, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM a
"""


@query(REPORT_SQL)
def class_report(spark, sf_dir):
    rows = metrics.class_report(judged(spark, sf_dir))
    return rows.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


AUC_SQL = f"""
WITH r AS (SELECT label, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS mid FROM {JUDGED}),
s AS (SELECT sum(mid) FILTER (label = 1) AS ranks, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS q FROM r)
SELECT round((ranks - p * (p + 1) / 2) / (p * q), 9) AS roc_auc FROM s
"""


@query(AUC_SQL)
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(judged(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(f"SELECT round(avg((label = prediction)::INT::DOUBLE), 9) AS accuracy FROM {JUDGED}")
def accuracy(spark, sf_dir):
    return metrics.accuracy(judged(spark, sf_dir)).select(F.round("accuracy", 9).alias("accuracy"))


@query(f"SELECT round(avg(a), 9) AS mean_accuracy, round(2 * stddev_pop(a), 9) AS two_std FROM (SELECT doc_id % 5 AS fold, avg((label = prediction)::INT::DOUBLE) AS a FROM {JUDGED} GROUP BY 1)")
def cv_summary(spark, sf_dir):
    rows = metrics.cv_summary(judged(spark, sf_dir).withColumn("fold", F.col("doc_id") % 5))
    return rows.select(*[F.round(c, 9).alias(c) for c in rows.columns])


@query("SELECT label, (dim - 1)::INT AS dim, round(avg(embedding[dim]::DOUBLE), 6) AS mean FROM embeddings, unnest(range(1, 65)) AS t(dim) GROUP BY label, dim")
def embedding_centroid(spark, sf_dir):
    rows = metrics.centroid(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return rows.select("label", "dim", F.round("mean", 6).alias("mean"))


@query()
def train_eval(spark, sf_dir):
    """Hold-out and cross-validated accuracy of label 0 against the rest. Iterative: held to a solver in the tests."""
    from residua.operators.model import train

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") == 0).cast("int").alias("label"))
    t = train(rows, "vec_id")
    return spark.createDataFrame([(t.train_accuracy, t.test_accuracy, t.cv_mean, t.cv_two_std)], "train_accuracy double, test_accuracy double, cv_mean double, cv_two_std double")


EMBED_SQL = f"""
WITH d AS (SELECT doc_id, substr({CLEAN}, 1, 1022) AS s FROM documents), c AS (SELECT doc_id, unnest(string_split(s, '')) AS c FROM d),
m AS (SELECT doc_id, i, sum((unicode(c) * (2 * i + 3)) % 17 - 8) AS total FROM c, unnest(range(16)) t(i) WHERE c <> '' GROUP BY doc_id, i)
SELECT doc_id, i::INT AS dim, round((coalesce(total, 0)::DOUBLE / greatest(length(s), 1))::FLOAT::DOUBLE, 5) AS x FROM d CROSS JOIN unnest(range(16)) t(i) LEFT JOIN m USING (doc_id, i)
"""


@query(EMBED_SQL)
def embed_test_vectors(spark, sf_dir):
    """The embedder's boundary, with the stand-in embedder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", cleaned().alias("sequence"))
    rows = embedding.embed(docs, "sequence", embedding.TestEmbedder, "test").filter(F.col("embedding").isNotNull())
    return rows.select("doc_id", F.posexplode("embedding").alias("dim", "x")).select("doc_id", "dim", F.round(F.col("x").cast("double"), 5).alias("x"))
