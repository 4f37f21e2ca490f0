"""Queries over the test tables with the operators of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.tokens import letters, runs
from palimpsest.llm.codepoints import replacements
from palimpsest.llm.graph_weights import key_terms, weigh_hits
from palimpsest.llm.keyword_pages import keyword_pages, scored
from palimpsest.llm.leakage import leaked, without_leaks
from palimpsest.llm.lookalikes import BLANK, HANGUL, alike_classes, alike_pairs, merged_entries, shown
from palimpsest.llm.mixing import kept_rules, mixture, shares
from palimpsest.llm.packing import containers_needed, packed
from palimpsest.llm.packing import kept_rules as packing_rules
from palimpsest.llm.splitting import bodies, pieces, rejoined
from palimpsest.llm.vocabulary import marked, record_count, term_counts
from palimpsest.llm.words import _folded
from palimpsest.queries_data import valid_postings
from palimpsest.queries_index import folded_sql
from palimpsest.session import read_spread, read_table, sized_broadcast

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return put


# ---- 1 and 2: terms


def hit_scores(spark: SparkSession, folder: str) -> DataFrame:
    hits = read_table(spark, folder, "search_query_result").select(
        "path_id", F.trim(F.regexp_replace(F.lower("query"), "[\"'“”„«»]", "")).alias("word"), "count"
    )
    lengths = (
        read_table(spark, folder, "index_combine_data").where("paths_count IS NOT NULL")
        .groupBy("path_id").agg(F.max(F.struct("combined_at", "paths_count")).alias("last"))
        .select("path_id", F.col("last.paths_count").alias("length"))
    )
    postings = valid_postings(spark, folder)
    total = record_count(postings, "word", "path_id")
    return weigh_hits(hits, lengths, term_counts(postings, "word", "path_id"), total)


@query("""
WITH hits AS (SELECT path_id, trim(regexp_replace(lower(query), '["''“”„«»]', '', 'g')) AS word, count FROM search_query_result),
df AS (SELECT word, count(DISTINCT path_id) AS n FROM postings WHERE path_id <> 0 GROUP BY word),
len AS (SELECT path_id, arg_max(paths_count, combined_at) AS n FROM index_combine_data WHERE paths_count IS NOT NULL GROUP BY path_id)
SELECT DISTINCT h.path_id, h.word FROM hits h JOIN len ON len.path_id = h.path_id LEFT JOIN df ON df.word = h.word
WHERE len.n > 0 AND coalesce(df.n, 0) <= 8 AND 2 * h.count >= len.n
""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    # full degree: the word can stand beside every other of the path
    return hit_scores(spark, folder).where("degree = length AND n_paths <= 8").select("path_id", "word")


@query("""
WITH hits AS (SELECT path_id, trim(regexp_replace(lower(query), '["''“”„«»]', '', 'g')) AS word, max(count) AS count
              FROM search_query_result WHERE count IS NOT NULL AND query IS NOT NULL AND path_id IS NOT NULL GROUP BY ALL),
p AS (SELECT word, path_id FROM postings WHERE word IS NOT NULL AND path_id <> 0),
total AS (SELECT count(DISTINCT path_id) AS n FROM p),
df AS (SELECT word, count(DISTINCT path_id) AS n FROM p GROUP BY word),
len AS (SELECT path_id, arg_max(paths_count, combined_at) AS n FROM index_combine_data WHERE paths_count IS NOT NULL GROUP BY path_id),
j AS (SELECT h.path_id, h.word, h.count, len.n AS length, coalesce(df.n, 0) AS n_paths,
             CAST(CASE WHEN h.count >= 1 THEN least(2 * h.count, len.n) ELSE 0 END AS BIGINT) AS degree
      FROM hits h JOIN len ON len.path_id = h.path_id LEFT JOIN df ON df.word = h.word WHERE len.n > 0)
SELECT path_id, word, count, length, n_paths, degree,
       round(degree / length * ln(((SELECT n FROM total) + 1) / greatest(n_paths, 1)), 6) AS score FROM j
""")
def p1_hit_scores(spark: SparkSession, folder: str) -> DataFrame:
    return hit_scores(spark, folder)


@query(f"""
WITH r AS (SELECT doc_id, string_split_regex({folded_sql("hex(encode(text))")}, '[^a-z]') AS a
           FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
u AS (SELECT doc_id, len(a) AS n, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM r),
t AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM u
      WHERE CASE WHEN i < n THEN length(w) BETWEEN 5 AND 14 ELSE length(w) BETWEEN 4 AND 19 END),
e AS (SELECT a.doc_id, a.w, count(DISTINCT b.w) AS degree
      FROM t a LEFT JOIN t b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 4 AND a.w <> b.w GROUP BY a.doc_id, a.w),
d AS (SELECT w, count(*) AS n FROM e GROUP BY w),
s AS (SELECT e.*, d.n, round(degree * ln(((SELECT count(*) FROM r) + 1) / d.n), 6) AS score FROM e JOIN d ON d.w = e.w)
SELECT doc_id, place, w AS term, degree, n AS n_records, score
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w) AS place FROM s) WHERE place <= 3
""")
def p1_document_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The three words that mark each document best, by its graph of words."""
    documents = read_spread(spark, folder, "documents").where("text IS NOT NULL")
    sequences = documents.select("doc_id", runs(letters(F.col("text"))).alias("words")).dropDuplicates(["doc_id"])
    return key_terms(sequences, "doc_id", "words")


@query("""
WITH p AS (SELECT word, path_id FROM postings WHERE word IS NOT NULL AND path_id <> 0),
c AS (SELECT word, count(DISTINCT path_id) AS n FROM p GROUP BY word)
SELECT word, CASE WHEN n <= 2 THEN 'rare' ELSE 'common' END AS mark
FROM c WHERE n <= 2 OR n > 0.2 * (SELECT count(DISTINCT path_id) FROM p)
""")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_term_counts(spark, folder).where("mark IS NOT NULL").select("word", "mark")


@query("""
WITH p AS (SELECT word, path_id FROM postings WHERE word IS NOT NULL AND path_id <> 0)
SELECT word, count(*) AS n_rows, count(DISTINCT path_id) AS n_paths,
       CASE WHEN count(DISTINCT path_id) <= 2 THEN 'rare'
            WHEN count(DISTINCT path_id) > 0.2 * (SELECT count(DISTINCT path_id) FROM p) THEN 'common' END AS mark
FROM p GROUP BY word
""")
def p2_term_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = valid_postings(spark, folder)
    counts = marked(term_counts(rows, "word", "path_id"), record_count(rows, "word", "path_id"))
    return counts.withColumnsRenamed({"term": "word", "n_records": "n_paths"})


# ---- 4: splitting, and the limit of a run that 4 and 7 share


def run_limits(spark: SparkSession, folder: str) -> DataFrame:
    """(run_id, run_limit): memory / threads in whole bytes; a run's rows repeat."""
    threads, memory = F.coalesce("config_threads_to_use", F.lit(1)), F.coalesce("config_local_index_memory", F.lit(50000))
    limit = F.when(threads >= 1, F.floor(memory / threads)).cast("long")
    return read_table(spark, folder, "run_config").groupBy("run_id").agg(F.max(limit).alias("run_limit"))


def limited_files(spark: SparkSession, folder: str) -> DataFrame:
    files = read_table(spark, folder, "files")
    used = run_limits(spark, folder).join(files.select("run_id").distinct(), "run_id", "left_semi")
    return files.select("run_id", "path", "content").join(sized_broadcast(used, 1_000_000), "run_id", "left")


FILE_LIMITS = """
lim AS (SELECT run_id, max(coalesce(config_local_index_memory, 50000) // coalesce(config_threads_to_use, 1)) AS run_limit
        FROM run_config GROUP BY run_id)
"""


@query(f"""
WITH {FILE_LIMITS}
SELECT DISTINCT path FROM files f JOIN lim ON lim.run_id = f.run_id WHERE octet_length(content) > run_limit
""")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = limited_files(spark, folder).withColumn("n_pieces", F.size(bodies(F.col("content"), F.col("run_limit"))))
    return cut.where("n_pieces > 1").select("path").distinct()


@query()
def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces(limited_files(spark, folder), "content", "run_limit")


@query("""
WITH lim AS (SELECT run_id, max(CASE WHEN coalesce(config_threads_to_use, 1) >= 1
             THEN coalesce(config_local_index_memory, 50000) // coalesce(config_threads_to_use, 1) END) AS run_limit FROM run_config GROUP BY run_id)
SELECT DISTINCT f.run_id, path, octet_length(content) AS n_bytes, md5(content) AS digest, CAST(0 AS BIGINT) AS n_too_long,
       CAST(0 AS BIGINT) AS n_misplaced, CAST(0 AS BIGINT) AS n_wrong_overlaps, coalesce(octet_length(content) > run_limit, false) AS cut
FROM files f LEFT JOIN lim ON lim.run_id = f.run_id WHERE octet_length(content) > 0
""")
def p4_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """What holds of the pieces of each file: they join to the whole, fit and overlap as they should."""
    return rejoined(limited_files(spark, folder).distinct(), ["run_id", "path"], "content", "run_limit")


# ---- 5: look-alikes


def _map_sql(changed: dict) -> str:
    """A table of characters as a MAP from code to UTF-8, both in hexadecimals."""
    pairs = ((f"{c:x}", "".join(map(chr, parts)).encode().hex()) for c, parts in sorted(changed.items()) if c)
    return "MAP {" + ", ".join(f"'{c}': '{x}'" for c, x in pairs) + "}"


def _mapped_sql(text: str, table: str) -> str:
    """`text` with each character replaced by the MAP `table`."""
    one = f"coalesce({table}[lower(to_hex(unicode(c)))], lower(hex(encode(c))))"
    return f"decode(from_hex(array_to_string(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN '' ELSE {one} END), '')))"


def _forms_sql(held: str = "segment_id IS NOT NULL AND entry_id IS NOT NULL AND") -> str:
    """CTE e(g, k, t, form): the form of each entry by a table of characters; the marks are composed by the database."""
    changed = {c: parts for c, parts in replacements(shown).items() if not HANGUL[0] <= c <= HANGUL[1]}
    return f"""m AS (SELECT {_map_sql(changed)} AS m),
w AS (SELECT DISTINCT segment_id AS g, entry_id AS k, word AS t FROM words_reversed WHERE {held} word IS NOT NULL),
e AS (SELECT g, k, t, trim(regexp_replace(nfc_normalize({_mapped_sql("t", "m")}), ' +', ' ', 'g'), ' ') AS form FROM w, m)"""


@query(f"""WITH {_forms_sql()}
SELECT DISTINCT a.k AS entry_id_a, b.k AS entry_id_b FROM e a JOIN e b ON a.g = b.g AND a.form = b.form AND a.k < b.k AND a.t <> b.t""")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return alike_pairs(read_table(spark, folder, "words_reversed"), "segment_id", "entry_id", "word")


@query(f"""WITH {_forms_sql()}, n AS (SELECT g, form, count(*) AS n_all FROM e GROUP BY ALL), o AS (SELECT g, form, t, count(*) AS n_own FROM e GROUP BY ALL)
SELECT k AS entry_id, e.form, n_all - n_own AS n_links FROM e JOIN n ON n.g = e.g AND n.form = e.form JOIN o ON o.g = e.g AND o.form = e.form AND o.t = e.t""")
def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return alike_classes(read_table(spark, folder, "words_reversed"), "segment_id", "entry_id", "word")


@query(f"""WITH {_forms_sql("")}, n AS (SELECT g, form, count(DISTINCT k) AS n_entries, count(DISTINCT t) AS n_spellings FROM e GROUP BY ALL),
v AS (SELECT e.g, e.form, count(DISTINCT u.v) AS n_values FROM e JOIN (SELECT DISTINCT segment_id AS g, word AS t, unnest(reversed) AS v FROM words_reversed) u
      ON u.g IS NOT DISTINCT FROM e.g AND u.t = e.t GROUP BY ALL)
SELECT n.g AS segment_id, n.form, n_entries, n_spellings, coalesce(n_values, 0) AS n_values
FROM n LEFT JOIN v ON v.g IS NOT DISTINCT FROM n.g AND v.form = n.form""")
def p5_merged_segments(spark: SparkSession, folder: str) -> DataFrame:
    return merged_entries(read_table(spark, folder, "words_reversed"), "segment_id", "entry_id", "word", "reversed")


# ---- 7: packing


def limited_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "index_combine_data")
    return rows.join(run_limits(spark, folder), "run_id", "left")


@query(f"""
WITH {FILE_LIMITS}, d AS (SELECT run_id, queue_id, path_id, max(coalesce(paths_size, 0)) AS s FROM index_combine_data
                          WHERE queue_id IS NOT NULL GROUP BY ALL)
SELECT d.run_id, d.queue_id FROM d JOIN lim ON lim.run_id = d.run_id
GROUP BY d.run_id, d.queue_id HAVING sum(s) > max(run_limit)
""")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    queues = limited_paths(spark, folder).where("queue_id IS NOT NULL")
    need = containers_needed(queues, ["run_id", "queue_id"], "path_id", "paths_size", "run_limit")
    return need.where("n_containers > 1").select("run_id", "queue_id")


@query()
def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    runs = packed(limited_paths(spark, folder), ["run_id"], "path_id", "paths_size", "run_limit")
    return runs.withColumnRenamed("container", "queue_id").withColumnRenamed("size", "paths_size")


@query("""
WITH d AS (SELECT run_id, path_id, max(coalesce(paths_size, 0)) AS s FROM index_combine_data GROUP BY ALL)
SELECT run_id, count(*) AS n_items, CAST(sum(greatest(s, 0)) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS n_twice, CAST(0 AS BIGINT) AS n_lost,
       CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_gaps FROM d GROUP BY run_id
""")
def p7_rules(spark: SparkSession, folder: str) -> DataFrame:
    """That every path is packed once and whole, within the limits, in queues that are numbered without gaps."""
    paths = limited_paths(spark, folder)
    return packing_rules(packed(paths, ["run_id"], "path_id", "paths_size", "run_limit"), paths, ["run_id"], "path_id", "paths_size", "run_limit")


@query(f"""
WITH {FILE_LIMITS}, d AS (SELECT run_id, path_id, max(coalesce(paths_size, 0)) AS s FROM index_combine_data GROUP BY ALL),
t AS (SELECT d.run_id, greatest(ceil(sum(s) / max(run_limit)), 1) AS least, max(s) AS most, sum(s) AS total, max(run_limit) AS cap FROM d JOIN lim ON lim.run_id = d.run_id GROUP BY d.run_id)
SELECT run_id, true AS not_fewer, true AS little_left FROM t WHERE cap >= 1
""")
def p7_near_least(spark: SparkSession, folder: str) -> DataFrame:
    """That no run takes fewer queues than its bytes ask for, nor more than a tenth, and one, above that."""
    room = p7_room(spark, folder).where("capacity >= 1")
    return room.select("run_id", (F.col("n_containers") >= F.col("at_least")).alias("not_fewer"), (F.col("n_containers") <= F.ceil(F.col("at_least") * 1.1) + 1).alias("little_left"))


@query()
def p7_room(spark: SparkSession, folder: str) -> DataFrame:
    """Per run: the queues that packing takes and the fewest that could do."""
    need = containers_needed(limited_paths(spark, folder), ["run_id"], "path_id", "paths_size", "run_limit")
    return need.withColumn("at_least", F.greatest(F.ceil(F.col("total") / F.col("capacity")), F.lit(1)))


# ---- 8 and 10: documents


def leaks(spark: SparkSession, folder: str) -> DataFrame:
    documents, items = read_spread(spark, folder, "documents"), read_table(spark, folder, "eval_items")
    return leaked(documents, "doc_id", "text", items, "item_id", "text")


def _word_lists_sql() -> str:
    """CTEs d1 and q1(id, form, ws): folded words of documents and items, without remarks (form 0) and with them."""
    table = {c: parts for c, parts in replacements(_folded).items() if c < 0x2E80 or 0xFB00 <= c <= 0xFFEF}
    joined = "regexp_replace(text, '[-\u2010\u00ad][ \\t]*\\r?\\n[ \\t]*(\\p{Ll})', '\\1', 'g')"
    bare = joined
    for remark in ("[(\\[][^()\\[\\]]*[)\\]]",) * 2 + ("\\*{2,}[^*]*\\*{2,}", " [–—] [^–—]*:[^–—]* [–—] "):
        bare = f"regexp_replace({bare}, '{remark}', ' ', 'g')"

    def words(name: str, table_: str, key: str) -> str:
        return f"""{name}0 AS (SELECT {key} AS id, f, unnest([0, 1]) AS form, unnest([bare, f]) AS t FROM (SELECT DISTINCT {key}, {joined} AS f, {bare} AS bare FROM {table_} WHERE text IS NOT NULL)),
{name}1 AS (SELECT DISTINCT id, form, list_filter(string_split({_mapped_sql("t", "m")}, ' '), lambda x: x <> '') AS ws FROM {name}0, m)"""

    return f"""m AS (SELECT {_map_sql(table)} AS m), {words("d", "documents", "doc_id")}, {words("q", "eval_items", "item_id")}"""


def _verbatim_sql() -> str:
    """All stretches of 20 words that a document and an item have in common, by joining every one with every one."""
    grams = "SELECT id, form, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (SELECT id, form, ws, unnest(range(1, len(ws) - 18)) AS i FROM {}1 WHERE len(ws) >= 20)"
    return f"""WITH {_word_lists_sql()}, d AS ({grams.format("d")}), q AS ({grams.format("q")}),
met AS (SELECT DISTINCT d.id AS doc_id, d.form AS df, q.id AS item_id, q.form AS qf, d.i - q.i AS diagonal, d.i FROM d JOIN q ON d.s = q.s),
runs AS (SELECT doc_id, item_id, i - row_number() OVER (PARTITION BY doc_id, df, item_id, qf, diagonal ORDER BY i) AS r, df, qf, diagonal FROM met),
len AS (SELECT doc_id, item_id, count(*) + 19 AS n FROM runs GROUP BY doc_id, item_id, df, qf, diagonal, r)
SELECT doc_id, item_id, max(n) AS longest FROM len GROUP BY ALL"""


def _leaks_sql() -> str:
    """Documents and items of which 18 of 20 words in a row are equal. Two exchanged words leave six in a row that are
    equal; all of those are joined, and the words of each document and item so met are compared one by one."""
    grams = "SELECT id, form, i, array_to_string(ws[i:i + 5], ' ') AS s FROM (SELECT id, form, ws, unnest(range(1, len(ws) - 4)) AS i FROM {}1 WHERE len(ws) >= 6)"
    return f"""WITH {_word_lists_sql()}, d AS ({grams.format("d")}), q AS ({grams.format("q")}),
met AS (SELECT DISTINCT d.id AS doc_id, d.form AS df, q.id AS item_id, q.form AS qf, d.i - q.i AS diagonal FROM d JOIN q ON d.s = q.s),
near AS (SELECT doc_id, item_id, diagonal, list_filter(range(1, len(q1.ws) + 1), lambda k: k + diagonal BETWEEN 1 AND len(d1.ws) AND d1.ws[k + diagonal] = q1.ws[k]) AS places
         FROM met JOIN d1 ON d1.id = doc_id AND d1.form = df JOIN q1 ON q1.id = item_id AND q1.form = qf),
found AS (SELECT doc_id, item_id, diagonal, places FROM near WHERE list_bool_or(list_transform(range(1, len(places) - 16), lambda k: places[k + 17] - places[k] < 20)))"""


@query(f"{_leaks_sql()} SELECT DISTINCT doc_id, item_id FROM found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(spark, folder).select("doc_id", "item_id")


#: CTE longest(item_id, doc_id, words, place, at): the runs of equal words of what _leaks_sql finds
_RUNS_SQL = """r AS (SELECT item_id, doc_id, n, diagonal, k, k - row_number() OVER (PARTITION BY n ORDER BY k) AS run
      FROM (SELECT item_id, doc_id, n, diagonal, unnest(places) AS k FROM (SELECT *, row_number() OVER () AS n FROM found))),
longest AS (SELECT item_id, doc_id, count(*) AS words, min(k) + diagonal - 1 AS place, min(k) - 1 AS "at" FROM r GROUP BY item_id, doc_id, n, diagonal, run)"""


@query(f"""{_leaks_sql()}, {_RUNS_SQL}
SELECT doc_id, item_id, words AS longest, place AS doc_word, "at" AS item_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, place, "at") AS k FROM longest) WHERE k = 1""")
def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Each finding with its longest verbatim match and where that stands."""
    return leaks(spark, folder)


@query(_verbatim_sql())
def p8_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that hold a stretch of 20 words as it is."""
    return leaks(spark, folder).where("longest >= 20").select("doc_id", "item_id", "longest")


@query(f"""{_leaks_sql()}, {_RUNS_SQL}
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(words) AS longest FROM longest GROUP BY item_id""")
def p8_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: the documents that hold it and its longest verbatim match."""
    found = leaks(spark, folder)
    return found.groupBy("item_id").agg(F.count("doc_id").alias("n_docs"), F.max("longest").alias("longest"))


@query(f"{_leaks_sql()} SELECT doc_id, source FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM found)")
def p8_clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select("doc_id", "source")
    return without_leaks(documents, "doc_id", leaks(spark, folder))


@query()
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return keyword_pages(read_spread(spark, folder, "documents"), "doc_id", "text")


@query()
def p10_page_shares(spark: SparkSession, folder: str) -> DataFrame:
    shares = scored(read_spread(spark, folder, "documents"), "doc_id", "text")
    return shares.select("doc_id", F.round("abnormal", 6).alias("abnormal"), F.round("keywords", 6).alias("keywords"))


# ---- 9: mixing


@query()
def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(read_spread(spark, folder, "documents"), read_table(spark, folder, "mix_targets"), "doc_id", "source", "text")


@query()
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(p9_mixture(spark, folder), read_table(spark, folder, "mix_targets"))


@query("SELECT source, target_share, true AS near, true AS within_repeats, CAST(0 AS BIGINT) AS n_twice FROM mix_targets")
def p9_rules(spark: SparkSession, folder: str) -> DataFrame:
    """That the mixture keeps to its targets, document by document."""
    return kept_rules(p9_mixture(spark, folder), read_table(spark, folder, "mix_targets"))
