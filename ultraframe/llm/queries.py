"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, find

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    more = (F.size("spans") - F.size("base")).cast("bigint").alias("n_by_context")
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"), more)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, word_count

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", F.col("source_size").cast("bigint"), "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract, fit

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_blocks", "n_kept", "n_turned")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs, index)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lengths import histogram, limits, token_lengths

    return limits(histogram(token_lengths(table(spark, sf_dir, "documents").select("text"))))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .forest import search

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_pii, op3_decontaminate, op4_mixing, op5_html_extraction, op6_toxicity, op7_token_counts, op8_nearest_neighbours, op9_substrings, op10_jaccard_join, op11_whitening, op12_simhash, op13_alignment)}

# The words of the contracts in DuckDB's expressions.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
        with l as (
            select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
            from documents where text is not null),
        t as (select *, trim(line) as a, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l),
        w as (
            select doc_id, i, a, lead(a) over o as b, lead(a, 2) over o as c, n, lead(n) over o as nb, lead(n, 2) over o as nc
            from t window o as (partition by doc_id order by i)),
        x as (
            select doc_id, i, 1 as size, a, null as b, null as c from w where n >= 20
            union all select doc_id, i, 2, a, b, null from w where b is not null and n + nb >= 20 and (n < 20 or nb < 20)
            union all select doc_id, i, 3, a, b, c from w where c is not null and (n + nb < 20 or nb + nc < 20) and a || b || c <> ''),
        f as (select doc_id, i, size, row_number() over (partition by size, a, b, c order by doc_id, i) as k from x),
        gone as (select distinct doc_id, i + d as i from f, (values (0), (1), (2)) as t(d) where k > 1 and d < size),
        m as (select l.*, gone.i is not null as removed from l left join gone using (doc_id, i))
        select d.doc_id, count(m.i)::bigint as n_lines, count(*) filter (removed)::bigint as n_removed,
               sha256(coalesce(string_agg(line, chr(10) order by m.i) filter (not removed), '')) as kept_sha256
        from documents d left join m using (doc_id) group by d.doc_id
    """,
    "op3_decontaminate": rf"""
        with d as (select doc_id, regexp_extract_all({FOLDED}, '{ALNUM}') as w from documents),
        b as (select item_id, regexp_extract_all({FOLDED}, '{ALNUM}') as w from benchmark),
        s as (select item_id, w, least(10, len(w)) as n from b where len(w) > 0),
        bw as (select item_id, n, array_to_string(w[k:k + n - 1], ' ') as g from s, unnest(range(1, len(w) - n + 2)) as t(k)),
        dw as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as g
               from d, (select distinct n from bw) as m, unnest(range(1, len(w) - n + 2)) as t(k)),
        hit as (select doc_id, k, n, item_id from dw join bw using (n, g)),
        words as (select doc_id, count(distinct k + j) as n_hit from hit, unnest(range(0, n)) as t(j) group by doc_id),
        items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
                  from (select distinct doc_id, item_id::varchar as item from hit where item_id is not null) group by doc_id)
        select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join words using (doc_id) left join items using (doc_id)
    """,
    "op9_substrings": rf"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') as w from documents),
        x as (select doc_id, k, array_to_string(w[k:k + 12], ' ') as g from d, unnest(range(1, len(w) - 11)) as t(k)),
        f as (select g, min(doc_id) as first from x group by g),
        gone as (select distinct doc_id, k + j as k from x join f using (g), unnest(range(0, 13)) as t(j) where first < doc_id),
        m as (select doc_id, k, word, gone.k is not null as removed
              from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as k from d) left join gone using (doc_id, k))
        select d.doc_id, len(any_value(w))::bigint as n_words, count(*) filter (removed)::bigint as n_removed,
               sha256(coalesce(string_agg(word, ' ' order by k) filter (not removed), '')) as kept_sha256
        from d left join m using (doc_id) group by d.doc_id
    """,
    "op10_jaccard_join": rf"""
        with recursive d as (select doc_id, regexp_extract_all({FOLDED}, '{SPACED}') as w from documents),
        s as (select distinct doc_id, array_to_string(w[k:k + 3], ' ') as g from d, unnest(range(1, greatest(len(w) - 2, 2))) as t(k) where len(w) > 0),
        n as (select doc_id, count(*) as n from s group by doc_id),
        c as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
        l as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * shared >= 85 * (p.n + q.n - shared)),
        e as (select x, y from l union all select y, x from l),
        r as (select doc_id as x, doc_id as y from d union select r.x, e.y from r join e on e.x = r.y)
        select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r.y)::bigint as component_id
        from d join r on r.x = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
    """,
}
