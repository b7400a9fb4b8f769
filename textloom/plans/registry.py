"""All queries of the retrieval engine, with the SQL that each is compared with.

SQL has no stemmer, so queries with SQL run over the unstemmed index; the stemmed ones are held against fixed results in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import GRAM, clean, hyphen_parts, kgrams, tokens
from textloom.operators import search, spelling
from textloom.operators.index import by_document, frequencies, gaps, indexed, indexed_blocks, occurrences, partitions_for
from textloom.plans.storage import index_of, scratch
from textloom.sources import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL --------------------------------------------------------------------------------------------------------

EDGE = r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$"
BASE = rf"""
lists AS (SELECT doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS l FROM documents),
tokens AS (SELECT * FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::INTEGER AS pos, unnest(l) AS raw FROM lists) WHERE raw <> ''),
cleaned AS (SELECT doc_id, pos, lower(replace(regexp_replace(raw, '{EDGE}', '', 'g'), '''', '')) AS word FROM tokens),
occ AS (SELECT doc_id, pos, unnest(list_distinct(list_append(string_split(word, '-'), word))) AS term FROM cleaned),
post AS (SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY ALL),
weights AS (SELECT doc_id, sqrt(sum(pow(1 + ln(tf), 2))) AS ld FROM post GROUP BY ALL),
words AS (SELECT DISTINCT word FROM cleaned),
n AS (SELECT count(*)::DOUBLE AS n FROM documents)
"""


def sql(rest: str, extra: str = "") -> str:
    return f"WITH {BASE}{',' + extra if extra else ''} {rest}"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def having(*terms: str) -> str:
    """Documents with all of some terms."""
    return " INTERSECT ".join(f"SELECT doc_id FROM post WHERE term = {literal(t)}" for t in terms)


def standing(*terms: str) -> str:
    """Documents with terms in consecutive places."""
    joins = " ".join(f"JOIN occ o{i} ON o{i}.doc_id = o0.doc_id AND o{i}.pos = o0.pos + {i} AND o{i}.term = {literal(t)}" for i, t in enumerate(terms) if i)
    return f"SELECT DISTINCT o0.doc_id FROM occ o0 {joins} WHERE o0.term = {literal(terms[0])}"


def like(*grams: str) -> str:
    """Documents with a word that has all grams."""
    return "SELECT DISTINCT doc_id FROM post JOIN words ON term = word WHERE " + " AND ".join(f"contains('$' || word || '$', {literal(g)})" for g in grams)


def best(terms: str, k: int = search.TOP) -> str:
    """Top k by score, for a table of (term, times)."""
    return sql(
        f"SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY ranked.score DESC, doc_id LIMIT {k}",
        f"""q AS ({terms}),
ranked AS (SELECT post.doc_id, sum((1 + ln(tf)) * times * ln(1 + n / df)) / any_value(ld) AS score
  FROM q JOIN vocab USING (term) JOIN post USING (term) JOIN weights USING (doc_id), n GROUP BY post.doc_id)""",
    )


def values(**times: int) -> str:
    return " UNION ALL ".join(f"SELECT {literal(t)} AS term, {n} AS times" for t, n in times.items())


def grams_sql(word: str) -> str:
    """Distinct grams of a SQL string."""
    p = f"('$' || {word} || '$')"
    runs = [f"list_transform(range(1, greatest(length({p}) - {k - 2}, 1)), lambda i: substring({p}, i, {k}))" for k in range(1, GRAM + 1)]
    return f"list_distinct(list_concat(list_concat({runs[0]}, {runs[1]}), {runs[2]}))"


#: DuckDB's levenshtein counts bytes: letters beyond ASCII are first exchanged for single bytes.
WIDE = "äöüßàâçéèêëîïôùûñáíóúÿœæ"
ONE = "".join(chr(1 + i) for i in range(len(WIDE)))


def narrow(word: str) -> str:
    return f"translate({word}, '{WIDE}', '{ONE}')"


# ---- registration -----------------------------------------------------------------------------------------------


def register(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("tokens", sql("SELECT doc_id, pos, raw FROM tokens"))
def _tokens(spark, sf_dir):
    return tokens(documents(spark, sf_dir))


@register("cleaned_words", sql("SELECT word, count(*) AS n FROM cleaned GROUP BY ALL"))
def _cleaned(spark, sf_dir):
    return tokens(documents(spark, sf_dir)).groupBy(clean(F.col("raw")).alias("word")).agg(F.count("*").alias("n"))


@register("hyphen_terms", sql("SELECT word, unnest(list_distinct(list_append(string_split(word, '-'), word))) AS term FROM words"))
def _hyphens(spark, sf_dir):
    return index_of(spark, sf_dir).words.select("word", F.explode(hyphen_parts(F.col("word"))).alias("term"))


@register("postings", sql("SELECT term, doc_id, count(*)::INTEGER AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM occ GROUP BY ALL"))
def _postings(spark, sf_dir):
    of = indexed(documents(spark, sf_dir), False)
    return of.select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


@register("postings_positions", sql("SELECT term, doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM occ GROUP BY ALL"))
def _positions(spark, sf_dir):
    return index_of(spark, sf_dir).postings.select("term", "doc_id", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


@register("postings_gaps", sql("SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post"))
def _gaps(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return gaps(index_of(spark, sf_dir).counted(), partitions_for(docs))


@register("vocab_df", sql("SELECT term, df, cf::BIGINT AS cf FROM vocab"))
def _vocabulary(spark, sf_dir):
    return index_of(spark, sf_dir).vocabulary.select("term", "df", "cf")


@register("vocab_by_letter", sql("SELECT substring(term, 1, 1) AS letter, count(*) AS terms, min(term) AS first_term, max(term) AS last_term FROM vocab WHERE term <> '' GROUP BY ALL"))
def _letters(spark, sf_dir):
    named = index_of(spark, sf_dir).vocabulary.where("term <> ''").groupBy(F.substring("term", 1, 1).alias("letter"))
    return named.agg(F.count("*").alias("terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


@register("letter_terms", sql("SELECT substring(term, 1, 1) AS letter, term FROM vocab WHERE term <> ''"))
def _letter_terms(spark, sf_dir):
    return search.terms_by_letter(index_of(spark, sf_dir))


@register("vocab_size", sql("SELECT (SELECT n::BIGINT FROM n) AS doc_count, count(*) AS term_count FROM vocab"))
def _sizes(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return index.vocabulary.agg(F.lit(index.size).cast("long").alias("doc_count"), F.count("*").alias("term_count"))


ASKED = ["the", "of", "gabagool", "and", "The!"]


@register("doc_frequency_lookup", sql("SELECT nth, q.word, coalesce(df, 0) AS df FROM q LEFT JOIN vocab ON term = lower(regexp_replace(q.word, '!', ''))", "q AS (" + " UNION ALL ".join(f"SELECT {i} AS nth, '{w}' AS word" for i, w in enumerate(ASKED)) + ")"))
def _frequencies(spark, sf_dir):
    return search.frequencies(index_of(spark, sf_dir), ASKED)


@register("doc_weights", sql("SELECT doc_id, round(ld, 6) AS ld FROM weights"))
def _weights(spark, sf_dir):
    return index_of(spark, sf_dir).weights.select("doc_id", F.round("ld", 6).alias("ld"))


BOOLEAN = {
    "bool_single": ("the", having("the")),
    "bool_and": ("the of and", having("the", "of", "and")),
    "bool_or": ("la + und + zzzz", f"{having('la')} UNION {having('und')}"),
    "bool_complex": ('"of the" and + la le', f"({standing('of', 'the')} INTERSECT {having('and')}) UNION ({having('la', 'le')})"),
    "bool_none": ("spelldrong", having("spelldrong")),
    "bool_punctuation": ("& the", having("", "the")),
    "bool_phrase": ('"of the"', standing("of", "the")),
    "bool_phrase_long": ('"in the of"', standing("in", "the", "of")),
    "bool_phrase_repeated": ('"the the"', standing("the", "the")),
    "bool_unmatched_quote": ('of the + "in the', f"({having('of', 'the')}) UNION ({standing('in', 'the')})"),
    "wildcard_prefix": ("thi*", like("$th", "thi")),
    "wildcard_suffix": ("*ght", like("ght", "ht$")),
    "wildcard_infix": ("*ion*ed*", like("ion", "ed")),
    "wildcard_and_term": ("tion* the", f"({like('$ti', 'tio', 'ion')}) INTERSECT ({having('the')})"),
    "wildcard_no_match": ("qqqqqqqzz* the", having("the")),
    "wildcard_bare": ("* the", having("the")),
}


def _boolean(query: str) -> Query:
    return lambda spark, sf_dir: search.boolean(index_of(spark, sf_dir), query)


for _name, (_query, _sql) in BOOLEAN.items():
    register(_name, sql(f"SELECT doc_id FROM ({_sql})"))(_boolean(_query))


@register("wildcard_exact", sql("SELECT DISTINCT doc_id FROM post JOIN words ON term = word WHERE word LIKE '%ion%ed%'"))
def _wildcard_exact(spark, sf_dir):
    return search.boolean(index_of(spark, sf_dir), "*ion*ed*", exact=True)


def _ranked(query: str) -> Query:
    return lambda spark, sf_dir: search.ranked(index_of(spark, sf_dir), query).select("doc_id", F.round("score", 6).alias("score"))


register("ranked_single", best(values(the=1)))(_ranked("the"))
register("ranked_multi", best(values(the=1, of=1, tion=1, **{"and": 1})))(_ranked("the of and tion"))
register("ranked_repeated", best(values(the=2, la=1)))(_ranked("the la The!"))
register("ranked_ten", best(values(the=1, of=1, la=1, le=1, und=1, die=1, que=1, de=1, **{"and": 1, "in": 1})))(_ranked("the of and in la le und die que de"))
register("ranked_wildcard", best("SELECT word AS term, count(*) AS times FROM (SELECT word FROM words WHERE contains('$' || word || '$', '$ti') AND contains('$' || word || '$', 'tio') UNION ALL SELECT 'the') GROUP BY ALL"))(_ranked("tio* the"))


@register("ranked_topk_ties", sql("SELECT doc_id, round(ld, 6) AS score FROM weights ORDER BY weights.ld DESC, doc_id LIMIT 25"))
def _ties(spark, sf_dir):
    scored = index_of(spark, sf_dir).weights.select("doc_id", F.col("ld").alias("score"))
    return search.top(scored, 25).select("doc_id", F.round("score", 6).alias("score"))


@register("kgram_index", sql("SELECT gram, count(*) AS n FROM (SELECT unnest(" + grams_sql("word") + ") AS gram FROM words) GROUP BY ALL"))
def _kgram_index(spark, sf_dir):
    return index_of(spark, sf_dir).kgrams.groupBy("gram").agg(F.count("*").alias("n"))


@register("kgram_words", sql("SELECT word FROM words WHERE contains('$' || word || '$', 'ion') AND contains('$' || word || '$', 'th')"))
def _kgram_words(spark, sf_dir):
    return search.with_grams(index_of(spark, sf_dir), ["ion", "th"]).select("word")


MISSPELT = ["thingg", "andd", "whhich", "tionn", "Qzv"]
NEAR = f"""q AS (SELECT unnest([{", ".join(map(literal, MISSPELT))}]) AS asked),
qg AS (SELECT asked, {grams_sql("asked")} AS g FROM q),
wg AS (SELECT word, {grams_sql("word")} AS g FROM words),
near AS (SELECT asked, word, len(list_intersect(qg.g, wg.g))::DOUBLE / (len(qg.g) + len(wg.g) - len(list_intersect(qg.g, wg.g))) AS overlap FROM qg, wg),
close AS (SELECT asked, word, overlap, levenshtein({narrow("asked")}, {narrow("word")})::INTEGER AS distance FROM near WHERE overlap > {spelling.OVERLAP}),
least AS (SELECT * FROM close QUALIFY distance = min(distance) OVER (PARTITION BY asked))"""


@register("jaccard_candidates", sql("SELECT asked, word, round(overlap, 6) AS overlap FROM close", NEAR))
def _jaccard(spark, sf_dir):
    return spelling.close_words(index_of(spark, sf_dir), MISSPELT).select("asked", "word", F.round("overlap", 6).alias("overlap"))


@register("edit_distance", sql(f"SELECT word, levenshtein({narrow('word')}, 'thing')::INTEGER AS distance FROM words"))
def _distance(spark, sf_dir):
    return index_of(spark, sf_dir).words.select("word", F.levenshtein("word", F.lit("thing")).alias("distance"))


@register("spelling_candidates", sql("SELECT asked, word, distance FROM least", NEAR))
def _candidates(spark, sf_dir):
    return spelling.candidates(index_of(spark, sf_dir), MISSPELT)


@register("best_spelling", sql("SELECT asked, word, coalesce(df, 0) AS df FROM least LEFT JOIN vocab ON vocab.term = word QUALIFY row_number() OVER (PARTITION BY asked ORDER BY coalesce(df, 0) DESC, word) = 1", NEAR))
def _best(spark, sf_dir):
    return spelling.best(index_of(spark, sf_dir), MISSPELT)


def _corrected(query: str, ranked: bool) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        new = spelling.corrected(index_of(spark, sf_dir), query, ranked)
        return spark.range(1).select(F.lit(query).alias("query"), F.lit(new).cast("string").alias("suggestion"))

    return run


def _suggestion(query: str, *parts: str) -> str:
    """The query put together from parts, of which every second one is a word to be corrected; null if all are known or one has no candidate."""
    words = parts[1::2]
    asked = ", ".join(map(literal, words))
    meant = lambda w: f"(SELECT meant FROM told WHERE asked = {literal(w)})"
    new = " || ".join(meant(x) if n % 2 else literal(x) for n, x in enumerate(parts))
    near = NEAR[NEAR.index("qg AS") :]
    return sql(
        f"SELECT {literal(query)} AS query, CASE WHEN (SELECT count(*) FROM told WHERE known) < {len(words)} AND (SELECT count(meant) FROM told) = {len(words)} THEN {new} END AS suggestion",
        f"""q AS (SELECT unnest([{asked}]) AS asked), {near},
first AS (SELECT asked, word FROM least LEFT JOIN vocab ON vocab.term = word QUALIFY row_number() OVER (PARTITION BY asked ORDER BY coalesce(df, 0) DESC, word) = 1),
told AS (SELECT asked, term IS NOT NULL AS known, CASE WHEN term IS NOT NULL THEN asked ELSE nullif(word, '') END AS meant FROM q LEFT JOIN vocab ON term = asked LEFT JOIN first USING (asked))""",
    )


register("spell_check_boolean", _suggestion('"thee off"+andd', '"', "thee", " ", "off", '"+', "andd", ""))(_corrected('"thee off"+andd', False))
register("spell_check_ranked", _suggestion("thee off andd tion*", "", "thee", " ", "off", " ", "andd", " tion*"))(_corrected("thee off andd tion*", True))
register("spell_check_known", _suggestion("the of", "", "the", " ", "of", ""))(_corrected("the of", False))
register("spell_check_hopeless", _suggestion("the qqxqqzzxq", "", "the", " ", "qqxqqzzxq", ""))(_corrected("the qqxqqzzxq", True))


@register("merge_blocks", sql("SELECT term, doc_id, count(*)::INTEGER AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM occ GROUP BY ALL"))
def _merge(spark, sf_dir):
    """Two blocks of documents, indexed one by one, as one index over all of them."""
    docs = documents(spark, sf_dir)
    even = F.pmod("doc_id", F.lit(2)) == 0
    of = indexed_blocks(docs.where(even), docs.where(~even), stemmed=False)
    return of.select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


@register("index_build", sql("SELECT count(*) AS postings, sum(tf)::BIGINT AS occurrences, count(DISTINCT term) AS terms, (SELECT round(sum(ld), 3) FROM weights) AS lengths FROM post"))
def _build(spark, sf_dir):
    """One pass over the texts: a document's length is its window's sum, carried by its first term."""
    from pyspark.sql import Window

    of = frequencies(occurrences(by_document(documents(spark, sf_dir).select("doc_id", "text")), False))
    own = Window.partitionBy("doc_id")
    of = of.select("term", "tf", F.sqrt(F.sum(F.pow(1 + F.log("tf"), F.lit(2))).over(own)).alias("ld"), F.min("term").over(own).alias("least"))
    length = F.sum(F.when(F.col("term") == F.col("least"), F.col("ld")))
    by_term = of.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), length.alias("ld"))
    return by_term.agg(F.sum("df").alias("postings"), F.sum("cf").alias("occurrences"), F.count("*").alias("terms"), F.round(F.sum("ld"), 3).alias("lengths"))


@register("doc_results", sql(f"SELECT doc_id, source, CASE WHEN length(text) > 75 THEN substring(text, 1, 75) || '...' ELSE text END AS snippet FROM documents WHERE doc_id IN ({having('the', 'tion')})"))
def _results(spark, sf_dir):
    found = search.boolean(index_of(spark, sf_dir), "the tion")
    return search.with_documents(found, documents(spark, sf_dir)).select("doc_id", "source", "snippet")


@register("ranked_stemmed")
def _ranked_stemmed(spark, sf_dir):
    return search.ranked(index_of(spark, sf_dir, True), "testing the things")


@register("bool_stemmed")
def _bool_stemmed(spark, sf_dir):
    return search.boolean(index_of(spark, sf_dir, True), '"of the" + thinges')


@register("vocab_stemmed")
def _vocab_stemmed(spark, sf_dir):
    return index_of(spark, sf_dir, True).vocabulary


# ---- sources and sinks: what is written to a folder of its own and read back -------------------------------------


@register("json_folder", "SELECT n_nationkey::BIGINT AS doc_id, n_name AS title, n_name AS text FROM nation")
def _json_folder(spark, sf_dir):
    """One JSON document a file, numbered by file name."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").alias("title"), F.col("n_name").alias("body"))
    folder = scratch(spark, "json")
    ingest.write_json(nation.repartitionById(nation.count(), F.col("n_nationkey").cast("int")).drop("n_nationkey"), folder)
    return ingest.read_json(spark, folder).select("doc_id", "title", "text")


@register("array_split", "SELECT row_number() OVER (ORDER BY r_regionkey)::INTEGER AS file_num, r_name AS body FROM region")
def _array_split(spark, sf_dir):
    """The members of one JSON file's array, numbered from 1."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", F.col("r_name").alias("body"))
    folder = scratch(spark, "array")
    ingest.write_json(region.agg(F.sort_array(F.collect_list(F.struct("r_regionkey", "body"))).alias("data")), folder)
    return ingest.split_array(spark, folder, "data", "struct<body:string>")


@register("scripts", "SELECT 'genre=' || r_name AS genre, n_name AS title, n_name || chr(10) || n_nationkey AS body FROM nation JOIN region ON n_regionkey = r_regionkey")
def _scripts(spark, sf_dir):
    """Text files in folders by genre, cleaned: the first line is the title."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey)
    text = F.concat(F.lit("  <script>Back to IMSDb"), "n_name", F.lit("\n"), F.col("n_nationkey").cast("string"), F.lit("</b> \\r\n"))
    folder = scratch(spark, "scripts")
    rows.select(text.alias("value"), F.col("r_name").alias("genre"), "n_nationkey").repartitionById(nation.count(), F.col("n_nationkey").cast("int")).drop("n_nationkey").write.partitionBy("genre").text(folder)
    return ingest.read_scripts(spark, folder).select("genre", "title", "body")


CLEANED = r"regexp_replace(replace(replace(replace('<b><!--' || text || ' Back to IMSDb \r ', 'Back to IMSDb', ''), '<b><!--', ''), '\r', ''), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')"


@register("clean_scripts", f"SELECT doc_id, md5({CLEANED}) AS cleaned FROM documents")
def _clean(spark, sf_dir):
    dirty = F.concat(F.lit("<b><!--"), "text", F.lit(" Back to IMSDb \\r "))
    return documents(spark, sf_dir).select("doc_id", F.md5(ingest.clean_script(dirty)).alias("cleaned"))


@register("csv_round_trip", "SELECT r_regionkey::BIGINT AS blocksize, r_regionkey / 4.0::DOUBLE AS time FROM region")
def _csv(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("blocksize"), (F.col("r_regionkey") / 4.0).alias("time"))
    folder = scratch(spark, "csv")
    ingest.write_csv(rows, folder)
    return ingest.read_csv(spark, folder, "blocksize long, time double")


# Stems by the published English stemmer.
STEMS = {
    "consign": "consign", "consigned": "consign", "consistency": "consist", "consolation": "consol", "knightly": "knight", "skies": "sky", "dying": "die", "generate": "generat",
    "generously": "generous", "hopping": "hop", "hoping": "hope", "falling": "fall", "relational": "relat", "cried": "cri", "ties": "tie", "gas": "gas", "kiwis": "kiwi", "happy": "happi",
    "say": "say", "by": "by", "controlling": "control", "agreed": "agre", "nationally": "nation", "succeed": "succeed", "the": "the", "thing": "thing", "things": "thing",
}
STEM_ROWS = ", ".join(f"({literal(w)}, {literal(t)})" for w, t in STEMS.items())


@register("stems", f"SELECT word, stem FROM (VALUES {STEM_ROWS}) t(word, stem)")
def _stems(spark, sf_dir):
    from textloom.functions.porter2 import stem_udf

    return spark.range(1).select(F.explode(F.array(*map(F.lit, STEMS))).alias("word")).select("word", stem_udf("word").alias("stem"))


@register(
    "stemmed_index",
    f"""WITH d AS (SELECT o_orderkey AS doc_id, (SELECT list(word ORDER BY word) FROM (VALUES {STEM_ROWS}) t(word, stem)) AS l FROM orders),
w AS (SELECT doc_id, l[1 + (doc_id * k + k) % len(l)] AS word FROM d, range(1, 6) r(k))
SELECT stem AS term, doc_id, count(*)::INTEGER AS tf FROM w JOIN (VALUES {STEM_ROWS}) t(word, stem) USING (word) GROUP BY ALL""",
)
def _stemmed(spark, sf_dir):
    """The stemmed index of five words an order, drawn from those whose stems are known."""
    words = F.array(*map(F.lit, sorted(STEMS)))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.element_at(words, (1 + F.pmod(F.col("doc_id") * k + k, F.lit(len(STEMS)))).cast("int")))
    return indexed(orders.select("doc_id", F.array_join(drawn, " ").alias("text")), True).select("term", "doc_id", "tf")
