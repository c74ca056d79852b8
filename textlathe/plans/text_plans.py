"""Text, edit, token and chunk queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlathe.functions import numbers as N
from textlathe.functions import text as X
from textlathe.functions import udfs as U
from textlathe.operators import edits as E
from textlathe.plans.base import Plans
from textlathe.runtime import spread, table

plans = Plans()
query = plans.query
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def docs(spark, sf):
    return table(spark, sf, "documents").where("text is not null")


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '(?m)^(#{2,3}[ \t]+[^\n]*)$', 1) AS h FROM documents WHERE text IS NOT NULL),
  r AS (SELECT doc_id, unnest(h) AS line, generate_subscripts(h, 1) AS pos FROM d),
  g AS (SELECT *, starts_with(line, '###') AS third, sum(CAST(NOT starts_with(line, '###') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM r),
  t AS (SELECT doc_id, part, max(CASE WHEN NOT third THEN regexp_replace(line, '^##[ \t]+', '') END) AS head, min(pos) AS pos, list(regexp_replace(line, '^###[ \t]+', '') ORDER BY pos) FILTER (third) AS subs FROM g WHERE part > 0 GROUP BY ALL)
SELECT doc_id, head, min(pos) AS pos, array_to_string(arg_max(coalesce(subs, []), part), '|') AS subs FROM t GROUP BY doc_id, head""")
def md_headlines(spark, sf):
    """Second-level headlines with the third-level ones under them; those before any are
    let go, and a headline that comes again begins anew in its old place."""
    rows = docs(spark, sf).select("doc_id", F.posexplode(X.headlines("text")).alias("pos", "line")).withColumn("third", F.col("line").startswith("###"))
    bare = F.regexp_replace("line", r"^#+[ \t]+", "")
    w = Window.partitionBy("doc_id").orderBy("pos")
    parts = rows.withColumn("part", F.sum((~F.col("third")).cast("int")).over(w)).where("part > 0").groupBy("doc_id", "part").agg(
        F.max(F.when(~F.col("third"), bare)).alias("head"), F.min("pos").alias("pos"), F.sort_array(F.collect_list(F.when(F.col("third"), F.struct("pos", bare.alias("t"))))).alias("subs"))
    last = F.max_by(F.array_join(F.transform("subs", lambda x: x["t"]), "|"), "part")
    return parts.groupBy("doc_id", "head").agg((F.min("pos") + 1).cast("bigint").alias("pos"), last.alias("subs"))


@query(r"SELECT doc_id, nullif(regexp_extract(text, '^# ([^\n]*)', 1), '') AS h1 FROM documents WHERE text IS NOT NULL")
def first_titles(spark, sf):
    return docs(spark, sf).select("doc_id", X.first_title("text").alias("h1"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '(?s)(.+?(?:[.!?](?:[ \t\n\x0b\f\r]+|$)|$))', 1)) AS n, array_to_string(regexp_extract_all(text, '(?s)(.+?(?:[.!?](?:[ \t\n\x0b\f\r]+|$)|$))', 1), '') = text AS lossless FROM documents WHERE text IS NOT NULL AND text <> ''")
def sentence_split(spark, sf):
    s = X.sentences("text")
    return docs(spark, sf).where("text != ''").select("doc_id", F.size(s).cast("bigint").alias("n"), (F.array_join(s, "") == F.col("text")).alias("lossless"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '([^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+)', 1)) AS n FROM documents WHERE text IS NOT NULL")
def split_keep(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.pieces_and_gaps("text")).cast("bigint").alias("n"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '[ \t\n\x0b\f\r]+', ' ', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def whitespace_collapse(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.collapsed("text")).alias("digest"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def content_hash(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(text, '(?i)(tokenizer)', '<mark>\\1</mark>', 'g')) AS digest FROM documents WHERE regexp_matches(text, '(?i)tokenizer')")
def highlight(spark, sf):
    return docs(spark, sf).where(F.col("text").rlike("(?i)tokenizer")).select("doc_id", F.md5(X.highlighted("text", "tokenizer")).alias("digest"))


@query("SELECT response_id, nullif(regexp_extract(response, '([ABCD])(?:[^A-Za-z0-9_]|$)', 1), '') AS letter FROM rag_response_df WHERE response IS NOT NULL")
def regex_answer(spark, sf):
    return table(spark, sf, "rag_response_df").where("response is not null").select("response_id", X.choice_letter("response").alias("letter"))


_S = 'trim("totalParams")'


@query(f"""WITH p AS (SELECT record_id, TRY_CAST(nullif(regexp_extract({_S}, '^([0-9]+(?:\\.[0-9]+)?)\\s*[TBMtbm]$', 1), '') AS DOUBLE) * CASE upper(right({_S}, 1)) WHEN 'T' THEN 1e12 WHEN 'B' THEN 1e9 WHEN 'M' THEN 1e6 END AS value FROM param_estimation),
  s AS (SELECT record_id, value, CASE WHEN value >= 1e12 THEN value / 1e12 WHEN value >= 1e9 THEN value / 1e9 ELSE value / 1e6 END AS x, CASE WHEN value >= 1e12 THEN 'T' WHEN value >= 1e9 THEN 'B' ELSE 'M' END AS u FROM p)
SELECT record_id, value, CASE WHEN x = floor(x) THEN CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) ELSE printf('%.2f', x) END || u AS shown FROM s WHERE value IS NOT NULL""")
def suffix_numbers(spark, sf):
    v = table(spark, sf, "param_estimation").select("record_id", N.parsed_suffix("totalParams").alias("value")).where("value is not null")
    return v.withColumn("shown", N.formatted_suffix("value"))


@query(r"SELECT DISTINCT model, regexp_replace(regexp_replace(regexp_replace(lower(trim(model)), '[_\s]+', '-', 'g'), '[^a-z0-9.\-]', '', 'g'), '-+', '-', 'g') AS slug, regexp_replace(model, '\s*\([^)]*\)\s*$', '') AS bare FROM param_estimation")
def name_normalize(spark, sf):
    return table(spark, sf, "param_estimation").select("model", X.model_slug("model").alias("slug"), X.without_remark("model").alias("bare")).distinct()


@query(r"SELECT seq, array_to_string(regexp_extract_all(lower(title), '([\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]|[0-9a-z\x{c0}-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}]+)', 1), ' ') AS units FROM search_record")
def keyword_encode(spark, sf):
    return table(spark, sf, "search_record").select("seq", F.array_join(X.keyword_units("title"), " ").alias("units"))


@query(r"""WITH q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+')) AS prefix FROM eval_item), w AS (SELECT DISTINCT seq, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS term FROM search_record)
SELECT prefix, count(DISTINCT seq) AS sections FROM q JOIN w ON starts_with(term, prefix) GROUP BY prefix""")
def prefix_match(spark, sf):
    """Query words of any length meet the title words that begin with them: each distinct
    title word is met by its prefixes as keys, and only then by its sections."""
    q = table(spark, sf, "eval_item").select(F.explode(X.tokens("query")).alias("prefix")).distinct()
    w = table(spark, sf, "search_record").select("seq", F.explode(X.tokens("title")).alias("term")).distinct()
    heads = w.select("term").distinct().select("term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substring("term", F.lit(1), n))).alias("prefix"))
    return q.join(heads, "prefix").join(w, "term").groupBy("prefix").agg(F.countDistinct("seq").alias("sections"))


@query(r"SELECT item_id, 'Context:' || chr(10) || source_text || chr(10) || '---' || chr(10) || 'Question: ' || query AS prompt FROM eval_item")
def template_render(spark, sf):
    return table(spark, sf, "eval_item").select("item_id", F.format_string("Context:\n%s\n---\nQuestion: %s", "source_text", "query").alias("prompt"))


@query("SELECT item_id, array_to_string(list_transform(list_zip(['A','B','C'], [subset, expected_page_id, rationale]), lambda z: z[1] || '. ' || z[2]), chr(10)) AS options FROM eval_item")
def choice_letters(spark, sf):
    both = F.zip_with(F.array(F.lit("A"), F.lit("B"), F.lit("C")), F.array("subset", "expected_page_id", "rationale"), lambda a, b: F.concat(a, F.lit(". "), b))
    return table(spark, sf, "eval_item").select("item_id", F.array_join(both, "\n").alias("options"))


@query("SELECT response_id, replace(replace(user_input, 'passages', 'pasages'), chr(10), ' ') AS spoilt FROM rag_response_df")
def text_substitution(spark, sf):
    return table(spark, sf, "rag_response_df").select("response_id", F.replace(F.replace("user_input", F.lit("passages"), F.lit("pasages")), F.lit("\n"), F.lit(" ")).alias("spoilt"))


@query(r"SELECT response_id, trim(regexp_replace(regexp_replace(regexp_replace(response, '^\*\*([^*]*)\*\*', '\1'), '```[a-z]*', '', 'g'), '^> ', ''), ' ') AS cleaned FROM rag_response_df WHERE response IS NOT NULL")
def reply_cleanup(spark, sf):
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace("response", r"^\*\*([^*]*)\*\*", "$1"), "```[a-z]*", ""), "^> ", "")
    return table(spark, sf, "rag_response_df").where("response is not null").select("response_id", F.trim(c).alias("cleaned"))


@query("SELECT doc_id, coalesce(title, 'Untitled') || '. (' || coalesce(CAST(year(published_at) AS VARCHAR), 'n.d.') || '). ' || source || '. ' || route AS apa, '@misc{doc' || doc_id || ',' || chr(10) || '  title = {' || coalesce(title, 'Untitled') || '},' || chr(10) || '  year = {' || coalesce(CAST(year(published_at) AS VARCHAR), 'n.d.') || '},' || chr(10) || '  howpublished = {' || route || '}' || chr(10) || '}' AS bibtex FROM documents")
def citation(spark, sf):
    year = F.coalesce(F.year("published_at").cast("string"), F.lit("n.d."))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("title", F.lit("Untitled")), F.lit(". ("), year, F.lit("). "), F.col("source"), F.lit(". "), F.col("route")).alias("apa"), X.bibtex(F.concat(F.lit("doc"), F.col("doc_id").cast("string")), {"title": F.coalesce("title", F.lit("Untitled")), "year": year, "howpublished": F.col("route")}).alias("bibtex"))


@query(f"""WITH n AS (SELECT response_id, query_id, len({TOK.format("response")}) AS tokens FROM rag_response_df WHERE response IS NOT NULL), b AS (SELECT query_id, len({TOK.format("min(user_input)")}) AS base FROM rag_response_df GROUP BY 1)
SELECT response_id, tokens, base, tokens - base AS delta, round((tokens - base) * 1.0 / nullif(tokens, 0), 6) AS share FROM n JOIN b USING (query_id)""")
def token_delta(spark, sf):
    """Differences to the baseline; shares are of the variant's own count."""
    r = table(spark, sf, "rag_response_df")
    base = r.groupBy("query_id").agg(F.min("user_input").alias("u")).select("query_id", F.size(X.tokens("u")).cast("bigint").alias("base"))
    n = r.where("response is not null").select("response_id", "query_id", F.size(X.tokens("response")).cast("bigint").alias("tokens"))
    d = F.col("tokens") - F.col("base")
    return n.join(base, "query_id").select("response_id", "tokens", "base", d.alias("delta"), F.round(F.try_divide(d, F.nullif("tokens", F.lit(0))), 6).alias("share"))


@query(r"""WITH w AS (SELECT response_id, unnest(list_filter(regexp_split_to_array(lower(response), '\s+'), lambda x: x <> '')) AS w, 'x' AS k FROM rag_response_df WHERE reference IS NOT NULL
    UNION ALL SELECT response_id, unnest(list_filter(regexp_split_to_array(lower(reference), '\s+'), lambda x: x <> '')), 'y' FROM rag_response_df WHERE reference IS NOT NULL),
  c AS (SELECT response_id, w, count(*) FILTER (k = 'x') AS x, count(*) FILTER (k = 'y') AS y FROM w GROUP BY ALL)
SELECT response_id, round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS jaccard FROM c GROUP BY response_id""")
def multiset_jaccard(spark, sf):
    r = table(spark, sf, "rag_response_df").where("reference is not null")
    return E.word_overlap(r, "response_id", "response", "reference").withColumn("jaccard", F.round("jaccard", 6))


@query("""WITH RECURSIVE one AS (SELECT query_id, arg_min(reference_contexts, response_id) AS a, arg_max(reference_contexts, response_id) AS b FROM rag_response_df WHERE reference_contexts IS NOT NULL GROUP BY 1),
  x AS (SELECT query_id, unnest(a) AS t, generate_subscripts(a, 1) AS i, b FROM one), y AS (SELECT query_id, i, t, unnest(b) AS u, generate_subscripts(b, 1) AS j FROM x),
  p AS (SELECT row_number() OVER (ORDER BY t, u) AS id, t, u, regexp_extract_all(lower(t), '[a-z0-9]+') AS ta, regexp_extract_all(lower(u), '[a-z0-9]+') AS ub FROM (SELECT DISTINCT t, u FROM y)),
  bw AS (SELECT id, unnest(ub) AS w, generate_subscripts(ub, 1) AS j FROM p),
  s AS (SELECT id, 0 AS i, j, 0 AS v FROM bw
    UNION ALL SELECT id, i, j, max(c) OVER (PARTITION BY id ORDER BY j) AS v FROM (
      SELECT s.id, s.i + 1 AS i, s.j, CASE WHEN p.ta[s.i + 1] = bw.w THEN coalesce(lag(s.v) OVER (PARTITION BY s.id ORDER BY s.j), 0) + 1 ELSE s.v END AS c
      FROM s JOIN bw ON bw.id = s.id AND bw.j = s.j JOIN p ON p.id = s.id WHERE s.i < len(p.ta))),
  l AS (SELECT p.t, p.u, coalesce(2.0 * max(s.v) FILTER (s.i = len(ta)) / nullif(any_value(len(ta) + len(ub)), 0), 0) AS f FROM p LEFT JOIN s USING (id) GROUP BY p.t, p.u)
SELECT query_id, round(sum(f / (1 + abs(i - j))) / sum(1.0 / (1 + abs(i - j))), 6) AS rouge FROM y JOIN l ON y.t = l.t AND y.u = l.u GROUP BY query_id""")
def rouge_topk(spark, sf):
    """Weighted mean similarity of each question's contexts in their order to its reference
    contexts' first record; weights fall with the distance of places."""
    r = table(spark, sf, "rag_response_df").where("reference_contexts is not null")
    one = r.groupBy("query_id").agg(F.min_by("reference_contexts", "response_id").alias("a"), F.max_by("reference_contexts", "response_id").alias("b"))
    x = one.select("query_id", F.posexplode("a").alias("i", "t"), "b").select("query_id", "i", "t", F.posexplode("b").alias("j", "u"))
    w = 1.0 / (1 + F.abs(F.col("i") - F.col("j")))
    return x.withColumn("s", U.rouge_l_udf("t", "u")).groupBy("query_id").agg(F.round(F.sum(w * F.col("s")) / F.sum(w), 6).alias("rouge"))


def typo_pairs(spark, sf):
    """Title words and what they are after a hash-chosen slip: pairs (typo, correction)."""
    w = table(spark, sf, "documents").where("title is not null").select(F.explode(X.tokens("title")).alias("correction")).distinct().where("length(correction) > 3")
    k = F.pmod(F.conv(F.substring(F.md5("correction"), 1, 7), 16, 10).cast("bigint"), F.length("correction") - 1).cast("int") + 1
    cut = F.concat(F.substring("correction", F.lit(1), k - 1), F.substring(F.col("correction"), k + 1, F.lit(1)), F.substring(F.col("correction"), k, F.lit(1)), F.substring(F.col("correction"), k + 2, F.lit(999)))
    drop = F.concat(F.substring("correction", F.lit(1), k), F.substring(F.col("correction"), k + 2, F.lit(999)))
    double = F.concat(F.substring("correction", F.lit(1), k), F.substring(F.col("correction"), k, F.lit(999)))
    return w.select(F.explode(F.array(cut, drop, double)).alias("typo"), "correction")


TYPOS = f"""w AS (SELECT DISTINCT unnest({TOK.format("title")}) AS c FROM documents WHERE title IS NOT NULL), k AS (SELECT c, CAST('0x' || substr(md5(c), 1, 7) AS BIGINT) % (length(c) - 1) + 1 AS k FROM w WHERE length(c) > 3),
  p AS (SELECT c AS correction, unnest([substr(c, 1, k - 1) || substr(c, k + 1, 1) || substr(c, k, 1) || substr(c, k + 2), substr(c, 1, k) || substr(c, k + 2), substr(c, 1, k) || substr(c, k)]) AS typo FROM k)"""


@query(f"WITH {TYPOS} SELECT typo, correction, damerau_levenshtein(typo, correction) AS distance, damerau_levenshtein(typo, correction) AS steps, correction AS rebuilt FROM p")
def edit_script(spark, sf):
    """Distance, number of edits, and what the edits make of the wrong word: the right one."""
    p = typo_pairs(spark, sf).withColumn("e", U.edit_script_udf("typo", "correction"))
    return p.select("typo", "correction", F.col("e.distance").cast("bigint").alias("distance"), F.size("e.edits").cast("bigint").alias("steps"), U.rebuilt_udf("typo", "correction", "e.edits").alias("rebuilt"))


@query(f"""WITH {TYPOS}, l AS (SELECT substr(c, k, 1) AS x, substr(c, k + 1, 1) AS y FROM k),
  r AS (SELECT 'transpose' AS op, y AS error, x AS fix FROM l WHERE x <> y UNION ALL SELECT 'transpose', x, y FROM l WHERE x <> y UNION ALL SELECT 'insert', '<ins>', y FROM l UNION ALL SELECT 'delete', x, '<del>' FROM l)
SELECT op, error, fix, count(*) AS n FROM r WHERE regexp_full_match(error, '[\\x20-\\x7e]*') AND regexp_full_match(fix, '[\\x20-\\x7e]*') GROUP BY ALL""")
def edit_kinds(spark, sf):
    """What stands for what in the edits of slips whose kind and place are known."""
    rows = E.printable(E.edit_rows(typo_pairs(spark, sf), "typo", "correction"))
    return rows.groupBy("op", "error", "fix").agg(F.count("*").alias("n"))


@query()
def edit_stats(spark, sf):
    rows = E.printable(E.edit_rows(typo_pairs(spark, sf), "typo", "correction"))
    return rows.groupBy("op", "error", "fix").agg(F.count("*").alias("n"), F.round(F.avg("pct_pos"), 6).alias("place"))


@query()
def edit_positions(spark, sf):
    """How edits of each kind spread over ten places of their words."""
    rows = E.edit_rows(typo_pairs(spark, sf), "typo", "correction")
    share = F.least(F.lit(10), F.width_bucket("pct_pos", F.lit(0.0), F.lit(1.0), F.lit(10)))
    n = rows.groupBy("op", share.cast("bigint").alias("place")).agg(F.count("*").alias("n"))
    return n.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("op")), 6))


@query(r"""SELECT doc_id, pos, nullif(regexp_extract(node, '^#{1,6} ([^\n]*)', 1), '') AS header, md5(node) AS digest
FROM (SELECT doc_id, unnest(n) AS node, generate_subscripts(n, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#{1,6} )', chr(1) || '\1', 'g'), chr(1)) AS n FROM documents WHERE text IS NOT NULL)) WHERE node <> ''""")
def header_nodes(spark, sf):
    """Texts cut before each Markdown heading, none of their signs lost."""
    parts = F.split(F.regexp_replace("text", r"(?m)^(#{1,6} )", "\x01$1"), "\x01")
    rows = docs(spark, sf).select("doc_id", F.posexplode(parts).alias("pos", "node")).where("node != ''")
    return rows.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.nullif(F.regexp_extract("node", r"^#{1,6} ([^\n]*)", 1), F.lit("")).alias("header"), F.md5("node").alias("digest"))


@query()
def sentence_chunks(spark, sf):
    """Whole texts as pieces of up to 512 tokens, no overlap, cut between sentences."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text").where("text is not null"))
    return d.select("doc_id", F.posexplode(U.pack_udf(512)("text", F.lit(""))).alias("pos", "piece"))


@query()
def typo_variants(spark, sf):
    """Each evaluation query spoilt at four rates in two versions, and its baseline."""
    model = E.ErrorModel.fit(E.edit_rows(typo_pairs(spark, sf), "typo", "correction"))
    return E.typo_variants(table(spark, sf, "eval_item"), "item_id", "query", model, [0.25, 0.5, 0.75, 1.0], 2)


@query()
def chunk_pack(spark, sf):
    """Sections as pieces within 256 tokens, context counted in."""
    r = spread(table(spark, sf, "search_record").select("seq", "title", "heading_key", "fragment_text"))
    heading = X.heading_of("heading_key", "title")
    context = F.when(heading == F.col("title"), F.col("title")).otherwise(F.concat_ws("\n", "title", heading))
    return r.select("seq", F.posexplode(U.pack_udf(256)("fragment_text", context)).alias("piece_no", "piece"))


@query("SELECT seq, md5(fragment_text) AS digest, true AS fits FROM search_record WHERE regexp_matches(fragment_text, '[[:alnum:]]')")
def chunk_lossless(spark, sf):
    """The packed pieces together are the section, and each is within the target or a
    single unit that can't be cut further."""
    r = spread(table(spark, sf, "search_record").select("seq", "fragment_text")).where(F.col("fragment_text").rlike("[a-zA-Z0-9]"))
    packed = r.select("seq", U.pack_udf(256)("fragment_text", F.lit("")).alias("pieces"))
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != ""))
    whole = lambda x: (words(x) <= 256) | ~F.regexp_replace(x, r"\s+$", "").rlike(r"[.!?]\s|\n\s*\S")
    return packed.select("seq", F.md5(F.array_join("pieces", "")).alias("digest"), F.forall("pieces", whole).alias("fits"))


WORD_PIECES = """t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM search_record WHERE title IS NOT NULL),
  v AS (SELECT w AS piece FROM t WHERE length(w) BETWEEN 2 AND 4 UNION SELECT '##' || substr(w, 2) FROM t WHERE length(w) BETWEEN 2 AND 5 UNION SELECT chr(CAST(k AS INT)) FROM (SELECT unnest(generate_series(97, 122)) AS k) UNION SELECT '##' || chr(CAST(k AS INT)) FROM (SELECT unnest(generate_series(97, 122)) AS k)),
  u AS (SELECT DISTINCT unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM eval_item)"""


@query(f"""WITH RECURSIVE {WORD_PIECES},
  s AS (SELECT w, 1 AS place, [] :: VARCHAR[] AS pieces FROM u
    UNION ALL SELECT w, place + best, list_append(pieces, piece) FROM (
      SELECT s.w, s.place, s.pieces, v.piece, length(v.piece) - CASE WHEN place > 1 THEN 2 ELSE 0 END AS best, row_number() OVER (PARTITION BY s.w ORDER BY length(v.piece) DESC) AS n
      FROM s JOIN v ON v.piece = CASE WHEN place > 1 THEN '##' ELSE '' END || substr(s.w, place, length(v.piece) - CASE WHEN place > 1 THEN 2 ELSE 0 END) AND (place > 1) = starts_with(v.piece, '##') WHERE place <= length(s.w)) WHERE n = 1)
SELECT u.w AS word, coalesce(array_to_string(max(pieces) FILTER (place > length(u.w)), ' '), '') AS pieces FROM u LEFT JOIN s ON s.w = u.w GROUP BY u.w""")
def word_pieces(spark, sf):
    """Query words in greedy longest pieces of a vocabulary; none for a word with a part
    that no piece covers. The vocabulary is a parameter: short title words and letters."""
    words = lambda name, c: table(spark, sf, name).where(F.col(c).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))).alias("w")).distinct()
    short = words("search_record", "title").where("length(w) between 2 and 5").collect()  # at most five signs: of bounded number
    letters = "abcdefghijklmnopqrstuvwxyz"
    pieces = sorted({*letters, *(f"##{x}" for x in letters), *(r.w for r in short if len(r.w) <= 4), *(f"##{r.w[1:]}" for r in short)})
    told = words("eval_item", "query").withColumn("ids", U.wordpiece_udf({p: n for n, p in enumerate(pieces)})(F.array("w")))
    vocab = spark.createDataFrame(list(enumerate(pieces)), "id int, piece string")
    spelt = told.select("w", F.posexplode("ids").alias("at", "id")).join(vocab, "id").groupBy("w").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    return told.join(spelt, "w", "left").select(F.col("w").alias("word"), F.coalesce(F.array_join(F.transform("p", lambda x: x["piece"]), " "), F.lit("")).alias("pieces"))


@query()
def bert_tokens(spark, sf):
    """Cleaned basic units and their pieces by a vocabulary of the corpus's frequent words."""
    words = table(spark, sf, "search_record").select(F.explode(X.basic_units("title")).alias("w")).groupBy("w").count().orderBy(F.desc("count"), "w").limit(2000)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    vocab = {p: n for n, p in enumerate([*letters, *[f"##{c}" for c in letters], *[r.w for r in words.collect() if len(r.w) > 1]])}
    units = table(spark, sf, "chunk").select("chunk_id", X.basic_units("heading").alias("units"))
    return units.select("chunk_id", F.size("units").alias("n_units"), U.wordpiece_udf(vocab)("units").alias("ids"))


@query()
def line_diff(spark, sf):
    """Changed lines between each section of a page and the one before it."""
    w = Window.partitionBy("page").orderBy("seq")
    s = table(spark, sf, "search_record").where("fragment_text is not null").select("seq", X.canonical_route("route").alias("page"), F.col("fragment_text").alias("b"))
    return s.withColumn("a", F.lag("b").over(w)).where("a != b").select("page", "seq", F.explode(U.line_diff_udf("a", "b")).alias("d")).select("page", "seq", "d.*")


@query("SELECT item_id, 9 AS versions, md5(query) AS baseline, true AS shaped FROM eval_item WHERE query IS NOT NULL")
def typo_versions(spark, sf):
    """Each query's versions: the baseline is the query, and every version has as many
    blanks."""
    gaps = lambda c: F.length(F.regexp_replace(c, r"\S", ""))  # noqa: E731 (a word of one letter may vanish, its blanks stay)
    v = typo_variants(spark, sf).join(table(spark, sf, "eval_item").select("item_id", "query"), "item_id")
    told = v.groupBy("item_id").agg(F.count("*").alias("versions"), F.max(F.when(F.col("rate") == 0, F.md5("variant"))).alias("baseline"), F.bool_and(gaps("variant") == gaps("query")).alias("shaped"))
    return told


@query("SELECT doc_id, len(embedding) AS dims FROM documents JOIN embeddings ON doc_id = vec_id")
def positional_join(spark, sf):
    """Rows of two tables that have the same number."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("bigint").alias("dims")), "doc_id")


@query("SELECT typo, arg_max(correction, n) AS correction FROM (SELECT lower(title) AS correction, substr(lower(title), 1, 8) AS typo, doc_id AS n FROM documents WHERE title IS NOT NULL) GROUP BY typo")
def last_wins(spark, sf):
    """Dictionaries where a later line replaces an earlier one."""
    d = table(spark, sf, "documents").where("title is not null").select(F.lower("title").alias("correction"), F.substring(F.lower("title"), 1, 8).alias("typo"), "doc_id")
    return d.groupBy("typo").agg(F.max_by("correction", "doc_id").alias("correction"))
