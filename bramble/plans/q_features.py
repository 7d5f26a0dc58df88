"""Registered queries over text cleaning, token functions and sparse features."""

from __future__ import annotations

from pyspark.sql import functions as F

from bramble.functions import hashing as H
from bramble.functions import scores as S
from bramble.functions import text as T
from bramble.operators import features as X
from bramble.operators import vectors as V
from bramble.plans import views as v
from bramble.plans.registry import query
from bramble.plans.shared import stage
from bramble.plans.views import with_views

WORDS = r"list_filter(regexp_split_to_array(replace(lower(text), ',', ''), '\s+'), lambda x: x <> '')"
#: Fixed value: punctuation rule of the spaced normaliser, as SQL over a column x.
SPACED = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '([''".,()!?])', ' \1 ', 'g'), '[;:]', ' ', 'g'), ' +', ' ', 'g'))"""


def _digest(name, col):
    """Long texts are compared by digest and length."""
    return F.md5(F.col(col).cast("binary")).alias(name), F.length(col).cast("long").alias("n")


@query("p07_words", f"SELECT doc_id, md5(array_to_string({WORDS}, ' ')) AS words, len({WORDS}) AS n FROM documents")
def p07(s, d):
    w = T.words(F.col("text"))
    return v.documents(s, d).select("doc_id", F.md5(F.array_join(w, " ").cast("binary")).alias("words"), F.size(w).cast("long").alias("n"))


@query("p08_tokens_with_end", r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(text, chr(10), ' </s> '), '[ \n\r\t\v\f]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, len(w) AS tokens, len(list_filter(w, lambda x: x = '</s>')) AS ends FROM t""")
def p08(s, d):
    t = v.documents(s, d).select("doc_id", T.tokens_with_end(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(F.filter("w", lambda x: x == T.END_OF_LINE)).cast("long").alias("ends"))


@query("p09_without_symbols", r"SELECT doc_id, md5(regexp_replace(text, '[^a-zA-Z_0-9 -/]+', '', 'g')) AS text, length(regexp_replace(text, '[^a-zA-Z_0-9 -/]+', '', 'g')) AS n FROM documents")
def p09(s, d):
    return v.documents(s, d).select("doc_id", T.without_symbols(F.col("text")).alias("x")).select("doc_id", *_digest("text", "x"))


@query("p10_without_quotes", "SELECT doc_id, md5(translate(text, '''\",', '')) AS text, length(translate(text, '''\",', '')) AS n FROM documents")
def p10(s, d):
    return v.documents(s, d).select("doc_id", T.without_quotes(F.col("text")).alias("x")).select("doc_id", *_digest("text", "x"))


IDENT = "SELECT p_partkey, 'cpe:2.3:' || CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'o' ELSE 'h' END || ':' || split_part(p_name, ' ', 1) || ':' || split_part(p_name, ' ', 2) || ':-:*:*:*:*:*:*:*' AS cpe FROM part"


def _identifiers(s, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "a").when(F.col("p_partkey") % 3 == 1, "o").otherwise("h")
    words = F.split("p_name", " ")
    return v.table(s, d, "part").select("p_partkey", F.concat(F.lit("cpe:2.3:"), kind, F.lit(":"), words[0], F.lit(":"), words[1], F.lit(":-:*:*:*:*:*:*:*")).alias("cpe"))


@query("p11_identifier_parts", f"""SELECT p_partkey, split_part(cpe, ':', 4) AS vendor, split_part(cpe, ':', 5) AS product, CASE split_part(cpe, ':', 3) WHEN 'h' THEN 'hardware' WHEN 'o' THEN 'operating_system' ELSE 'application' END AS category,
    CASE WHEN split_part(cpe, ':', 4) = split_part(cpe, ':', 5) THEN split_part(cpe, ':', 4) ELSE split_part(cpe, ':', 4) || ' ' || split_part(cpe, ':', 5) END AS name FROM ({IDENT})""")
def p11(s, d):
    return _identifiers(s, d).select("p_partkey", T.identifier_parts(F.col("cpe")).alias("p")).select("p_partkey", "p.vendor", "p.product", "p.category", "p.name")


@query("p12_spaced_punctuation", f"SELECT doc_id, md5({SPACED.format(x='text')}) AS text, length({SPACED.format(x='text')}) AS n FROM documents")
def p12(s, d):
    return v.documents(s, d).select("doc_id", T.spaced_punctuation(F.col("text")).alias("x")).select("doc_id", *_digest("text", "x"))


PLAIN = SPACED.format(x="regexp_replace(regexp_replace(translate(text, '’‘`´“”„', chr(39) || chr(39) || chr(39) || chr(39) || '\"\"\"'), '[0-9]', ' ', 'g'), '[=*|«»]', ' ', 'g')")


@query("p13_plain_text", f"SELECT doc_id, md5({PLAIN}) AS text, length({PLAIN}) AS n FROM documents")
def p13(s, d):
    return v.documents(s, d).select("doc_id", T.plain_text(F.col("text")).alias("x")).select("doc_id", *_digest("text", "x"))


def _markup_sql() -> str:
    x = r"regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    x = rf"regexp_replace({x}, '\[\[(?:[^|\]]*\|)?([^\]]*)\]\]', '\1', 'g')"
    x = rf"lower(regexp_replace({x}, '\{{\{{[^}}]*\}}\}}|<[^>]*>|&[#\w]+;', ' ', 'g'))"
    for digit, name in enumerate("zero one two three four five six seven eight nine".split()):
        x = f"replace({x}, '{digit}', ' {name} ')"
    return f"trim(regexp_replace({x}, '[^a-z]+', ' ', 'g'))"


def _lines_sql() -> str:
    x = r"regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')"
    x = rf"regexp_replace({x}, '\[\[(?:[^|\]]*\|)?([^\]]*)\]\]', '\1', 'g')"
    x = rf"lower(regexp_replace({x}, '\{{\{{[^}}]*\}}\}}|<[^>]*>|&[#\w]+;', ' ', 'g'))"
    return rf"list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(regexp_replace(l, '[ \t\r\f\x0B]+', ' ', 'g'))), lambda l: contains(l, ' '))"


@query("p14_markup_to_lines", f"SELECT page_id, len({_lines_sql()}) AS lines, md5(array_to_string({_lines_sql()}, chr(10))) AS text FROM pages WHERE NOT contains(lower(html), '#redirect')")
def p14b(s, d):
    pages = v.table(s, d, "pages").where(~T.is_redirect(F.col("html")))
    return pages.select("page_id", T.markup_to_lines(F.col("html")).alias("x")).select("page_id", F.size("x").cast("long").alias("lines"), F.md5(F.array_join("x", "\n").cast("binary")).alias("text"))


@query("p14_markup_to_text", f"SELECT page_id, md5({_markup_sql()}) AS text, length({_markup_sql()}) AS n FROM pages")
def p14(s, d):
    return v.table(s, d, "pages").select("page_id", T.markup_to_text(F.col("html")).alias("x")).select("page_id", *_digest("text", "x"))


@query("p15_first_words", r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) = 0 THEN 'filling empty' ELSE array_to_string(w[1:12], ' ') END AS text FROM t")
def p15(s, d):
    return v.documents(s, d).select("doc_id", T.first_words(F.col("text"), 12).alias("text"))


@query("p19_blank_and_extracted_labels", with_views("SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, '0 ' || (SELECT count(*) FROM order_features f WHERE f.doc_id = o.doc_id) AS blanked FROM order_labels o GROUP BY doc_id", "order_labels", "order_features"))
def p19(s, d):
    labels = v.order_labels(s, d).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"))
    n = v.order_features(s, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return labels.join(n, "doc_id").select("doc_id", "labels", F.concat(F.lit("0 "), F.col("n").cast("string")).alias("blanked"))


@query("p20_glued_labels", with_views("SELECT f.doc_id, labels || ' ' || n AS line FROM (SELECT doc_id, count(*) AS n FROM order_features GROUP BY doc_id) f JOIN (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM order_labels GROUP BY doc_id) l USING (doc_id)", "order_labels", "order_features"))
def p20(s, d):
    labels = v.order_labels(s, d).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"))
    n = v.order_features(s, d).groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.join(labels, "doc_id").select("doc_id", F.concat_ws(" ", "labels", F.col("n").cast("string")).alias("line"))


@query("p21_rows_per_tree", "SELECT tree, o_orderkey AS doc_id FROM orders, (SELECT unnest([0, 1, 2]) AS tree) WHERE ('0x' || substr(md5('42|' || tree || '|' || o_orderkey), 1, 8))::BIGINT / 4294967296 < 0.4")
def p21(s, d):
    from bramble.operators.split import per_tree_sample

    return per_tree_sample(v.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")), 3, 0.4)


@query("p21_counted_rows_per_tree", "SELECT tree, o_orderkey AS doc_id FROM orders, (SELECT unnest([0, 1, 2]) AS tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY ('0x' || substr(md5('42|' || tree || '|' || o_orderkey), 1, 8))::BIGINT, o_orderkey) <= 500")
def p21b(s, d):
    from bramble.operators.split import per_tree_count

    return per_tree_count(v.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")), 3, 500)


@query("t21_bagging_by_content", "SELECT member, doc_id FROM documents, (SELECT unnest([0, 1]) AS member) WHERE ('0x' || substr(md5('42|' || member || '|' || coalesce(text, '')), 1, 8))::BIGINT / 4294967296 < 0.8")
def t21b(s, d):
    from bramble.operators.split import bagged

    return bagged(v.documents(s, d), 2, 0.8, content="text")


@query("t21_bagging", "SELECT member, o_orderkey AS doc_id FROM orders, (SELECT unnest([0, 1]) AS member) WHERE ('0x' || substr(md5('42|' || member || '|' || o_orderkey), 1, 8))::BIGINT / 4294967296 < 0.8")
def t21(s, d):
    from bramble.operators.split import bagged

    return bagged(v.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")), 2, 0.8)


@query("p22_subsampled_words", with_views("""WITH voc AS (SELECT token, count(*) / (SELECT count(*) FROM tokens) AS f FROM tokens GROUP BY token)
    SELECT doc_id, pos, token FROM tokens JOIN voc USING (token) WHERE ('0x' || substr(md5('42|' || doc_id || '|' || pos), 1, 8))::BIGINT / 4294967296 <= sqrt(0.001 / f) + 0.001 / f""", "tokens"))
def p22(s, d):
    t = v.tokens(s, d)
    return X.frequent_word_kept(t, t.groupBy("token").agg(F.count("*").alias("n")), 0.001)


@query("p23_hashed_rows", "SELECT o_orderkey AS doc_id FROM orders WHERE ('0x' || substr(md5('7|' || o_orderkey), 1, 8))::BIGINT / 4294967296 <= 0.3")
def p23(s, d):
    return v.table(s, d, "orders").where(H.uniform(7, "o_orderkey") <= 0.3).select(F.col("o_orderkey").alias("doc_id"))


@query("p26_row_weights", "SELECT doc_id, coalesce(1 + quality, 1)::DOUBLE AS weight FROM documents LEFT JOIN labels USING (doc_id)")
def p26(s, d):
    lines = v.documents(s, d).join(v.table(s, d, "labels"), "doc_id", "left").select("doc_id", F.concat_ws(" ", F.when(F.col("quality").isNotNull(), F.concat(F.lit("__weight__:"), (1 + F.col("quality")).cast("string"))), F.lit("a b")).alias("line"))
    return lines.select("doc_id", T.parse_label_line(F.col("line"))["weight"].alias("weight"))


# --- n-grams, windows and hashes ------------------------------------------------------------------------------------


@query("w06_word_ngrams", with_views("""WITH w AS (SELECT doc_id, list(token ORDER BY pos) AS w FROM tokens GROUP BY doc_id), g AS (SELECT doc_id, 2 AS k, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS gram FROM w
    UNION ALL SELECT doc_id, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w) SELECT doc_id, k, count(*) AS n, count(DISTINCT gram) AS d, min(gram) AS first FROM g GROUP BY doc_id, k""", "tokens"))
def w06(s, d):
    w = v.documents(s, d).select("doc_id", T.words(F.col("text")).alias("w"))
    grams = lambda k: w.select("doc_id", F.lit(k).alias("k"), T.word_ngrams(F.col("w"), k).alias("g"))
    both = grams(2).unionByName(grams(3)).where(F.size("g") > 0)
    return both.select("doc_id", "k", F.size("g").cast("long").alias("n"), F.size(F.array_distinct("g")).cast("long").alias("d"), F.array_min("g").alias("first"))


@query("w07_token_windows", with_views("SELECT doc_id, CASE WHEN count(*) <= 20 THEN 1 ELSE count(*) - 19 END AS windows, least(count(*), 20) AS width FROM tokens GROUP BY doc_id", "tokens"))
def w07(s, d):
    w = v.documents(s, d).select("doc_id", T.windows(T.words(F.col("text")), 20).alias("w")).where(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("long").alias("windows"), F.size(F.col("w")[0]).cast("long").alias("width"))


@query("w08_context_pairs", with_views("""WITH c AS (SELECT *, ('0x' || substr(md5('42|' || doc_id || '|' || pos), 1, 8))::BIGINT % 3 + 1 AS reach FROM tokens)
    SELECT c.doc_id, count(*) AS pairs FROM c JOIN tokens t ON t.doc_id = c.doc_id AND t.pos <> c.pos AND abs(t.pos - c.pos) <= reach GROUP BY c.doc_id""", "tokens"))
def w08(s, d):
    return X.context_pairs(v.tokens(s, d), 3).groupBy("doc_id").agg(F.count("*").alias("pairs"))


@query("f01_hashed_ngrams", with_views("""WITH u AS (SELECT doc_id, token AS gram FROM tokens UNION SELECT doc_id, token || ' ' || lead(token) OVER (PARTITION BY doc_id ORDER BY pos) FROM tokens),
    h AS (SELECT doc_id, ('0x' || substr(md5(gram), 1, 8))::BIGINT AS h FROM u WHERE gram IS NOT NULL) SELECT doc_id, (h >> 1) % 1048576 AS index, sum(CASE WHEN h % 2 = 1 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value FROM h GROUP BY ALL""", "tokens"))
def f01(s, d):
    w = v.documents(s, d).select("doc_id", T.words(F.col("text")).alias("w"))
    grams = w.select("doc_id", F.explode(F.array_distinct(F.concat("w", T.word_ngrams(F.col("w"), 2)))).alias("gram"))
    h = H.signed_feature(F.col("gram"), 1 << 20)
    return grams.select("doc_id", h["index"].alias("index"), h["sign"].alias("sign")).groupBy("doc_id", "index").agg(F.sum("sign").alias("value"))


FNV = "list_reduce([2166136261::HUGEINT] || [('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::HUGEINT FOR i IN range(0, octet_length(encode(w)))], lambda h, b: (xor(h, CASE WHEN b >= 128 THEN b + 4294967040 ELSE b END) * 16777619) % 4294967296)"


@query("f07_fnv_hash", with_views(f"SELECT w AS token, ({FNV})::BIGINT AS h FROM (SELECT DISTINCT token AS w FROM tokens)", "tokens"))
def f07(s, d):
    return v.tokens(s, d).select("token").distinct().select("token", H.fnv1a(F.col("token")).alias("h"))


@query("f08_ngram_buckets", with_views(f"""WITH f AS MATERIALIZED (SELECT w AS token, {FNV} AS h FROM (SELECT DISTINCT token AS w FROM tokens)),
    p AS (SELECT DISTINCT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM tokens)
    SELECT a || ' ' || b AS gram, ((x.h * 116049371 + y.h) % 10000000)::BIGINT AS bucket FROM p JOIN f x ON x.token = a JOIN f y ON y.token = b""", "tokens"))
def f08(s, d):
    return H.pair_buckets(v.documents(s, d), T.words(F.col("text")), 10_000_000)


@query("f09_char_ngrams", with_views("""WITH w AS (SELECT DISTINCT token, '<' || token || '>' AS m FROM tokens), g AS (SELECT token, unnest(list_concat([substr(m, i, 3) FOR i IN range(1, length(m) - 1)], [substr(m, i, 4) FOR i IN range(1, length(m) - 2)])) AS gram FROM w)
    SELECT token, count(*) AS n, min(gram) AS first, max(gram) AS last FROM g GROUP BY token""", "tokens"))
def f09(s, d):
    g = v.tokens(s, d).select("token").distinct().select("token", T.char_ngrams(F.col("token"), 3, 4).alias("g")).where(F.size("g") > 0)
    return g.select("token", F.size("g").cast("long").alias("n"), F.array_min("g").alias("first"), F.array_max("g").alias("last"))


# --- TF-IDF and norms -----------------------------------------------------------------------------------------------


TF = r"tf AS (SELECT doc_id, token AS feature, count(*)::DOUBLE AS value FROM tokens WHERE regexp_full_match(token, '\w\w+') GROUP BY ALL)"
SUMMARY = "SELECT doc_id, count(*) AS features, round(sum(value), 5) AS total, round(max(value), 5) AS most FROM r GROUP BY doc_id"


def _tf(s, d):
    return X.term_counts(v.documents(s, d), F.filter(T.words(F.col("text")), lambda w: w.rlike(r"^\w\w+$")))


def _summary(df):
    return df.groupBy("doc_id").agg(F.count("*").alias("features"), F.round(F.sum("value"), 5).alias("total"), F.round(F.max("value"), 5).alias("most"))


@query("f02_tfidf_smooth", with_views(f"""WITH {TF}, df AS (SELECT feature, count(*) AS df FROM tf GROUP BY feature), x AS (SELECT doc_id, feature, value * (ln((1 + (SELECT count(DISTINCT doc_id) FROM tf)) / (1 + df)) + 1) AS value FROM tf JOIN df USING (feature)),
    r AS (SELECT doc_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM x) {SUMMARY}""", "tokens"))
def f02(s, d):
    tf = _tf(s, d)
    return _summary(X.tfidf(tf, tf))


@query("f03_tfidf_log", with_views("""WITH df AS (SELECT feature, count(*) AS df FROM order_features GROUP BY feature), x AS (SELECT doc_id, feature, (1 + ln(value)) * ln((SELECT count(DISTINCT doc_id) FROM order_features) / df) AS value FROM order_features JOIN df USING (feature))
    SELECT doc_id, feature, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 4) AS value FROM x""", "order_features"))
def f03(s, d):
    f = v.order_features(s, d)
    return X.tfidf(f, f, formula="log").select("doc_id", "feature", F.round("value", 4).alias("value"))


@query("f04_tfidf_vocabulary", with_views(f"""WITH {TF}, df AS (SELECT feature, count(*) AS df FROM tf GROUP BY feature), r AS (SELECT doc_id, feature, value / sum(value) OVER (PARTITION BY doc_id) * ln((SELECT count(DISTINCT doc_id) FROM tf) / (1 + df)) AS value FROM tf JOIN df USING (feature)) {SUMMARY}""", "tokens"))
def f04(s, d):
    tf = _tf(s, d)
    return _summary(X.tfidf(tf, tf, formula="vocabulary", normalise=False))


@query("f05_tfidf_graph", with_views(f"""WITH {TF}, df AS (SELECT feature, count(*) AS df FROM tf GROUP BY feature), r AS (SELECT doc_id, feature, value * ln((SELECT count(DISTINCT doc_id) FROM tf) / df) AS value FROM tf JOIN df USING (feature)) {SUMMARY}""", "tokens"))
def f05(s, d):
    tf = _tf(s, d)
    return _summary(X.tfidf(tf, tf, formula="graph", normalise=False))


@query("f06_unit_rows", with_views("SELECT doc_id, feature, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM order_features", "order_features"))
def f06(s, d):
    return X.l2_normalise(v.order_features(s, d)).select("doc_id", "feature", F.round("value", 6).alias("value"))


@query("a13_column_norms", with_views("SELECT feature, round(sqrt(sum(value * value)), 6) AS norm FROM order_features GROUP BY feature", "order_features"))
def a13(s, d):
    return X.column_norms(v.order_features(s, d)).select("feature", F.round("norm", 6).alias("norm"))


UNIT = "u AS (SELECT doc_id, feature, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM order_features)"


@query("a12_label_centroids", with_views(f"WITH {UNIT}, s AS (SELECT label, feature, sum(value) AS value FROM order_labels JOIN u USING (doc_id) GROUP BY ALL) SELECT label, feature, round(value / sqrt(sum(value * value) OVER (PARTITION BY label)), 5) AS value FROM s", "order_labels", "order_features"))
def a12(s, d):
    return X.label_centroids(v.order_labels(s, d), v.order_features(s, d)).select("label", "feature", F.round("value", 5).alias("value"))


@query("a14_label_spheres", with_views("""WITH n AS (SELECT label, count(*) AS n FROM order_labels GROUP BY label), u AS (SELECT label, feature, sum(value) / any_value(n) AS u FROM order_labels JOIN order_features USING (doc_id) JOIN n USING (label) WHERE n > 1 GROUP BY ALL),
    x AS (SELECT doc_id, sum(value * value) AS xx FROM order_features GROUP BY doc_id), uu AS (SELECT label, sum(u * u) AS uu FROM u GROUP BY label),
    xu AS (SELECT label, doc_id, sum(value * u) AS xu FROM order_labels JOIN order_features USING (doc_id) JOIN u USING (label, feature) GROUP BY ALL)
    SELECT label, n, round(coalesce(max(xx + uu - 2 * xu), 0), 3) AS radius FROM n LEFT JOIN xu USING (label) LEFT JOIN x USING (doc_id) LEFT JOIN uu USING (label) GROUP BY label, n""", "order_labels", "order_features"))
def a14(s, d):
    _, radii = X.label_spheres(v.order_labels(s, d), v.order_features(s, d))
    return radii.select("label", "n", F.round("radius", 3).alias("radius"))


# --- co-occurrence --------------------------------------------------------------------------------------------------


TURNS = r"""WITH turns AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(regexp_split_to_array(replace(lower(text), ',', ''), '\s+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
    wins AS (SELECT row_number() OVER () AS id, w[i:i + 19] AS w FROM (SELECT w, unnest(range(1, greatest(1, len(w) - 19) + 1)) AS i FROM turns WHERE len(w) > 0)),
    words AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest(w) AS word FROM wins) GROUP BY word),
    cells AS (SELECT id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM wins),
    pairs AS (SELECT a.t AS a, b.t AS b, count(*) AS n FROM cells a JOIN cells b ON a.id = b.id AND a.i <> b.i AND a.t <> b.t GROUP BY ALL),
    total AS (SELECT count(*) AS total FROM wins),
    pmi AS (SELECT p.a, p.b, ln(p.n * total / (x.n * y.n)) AS weight FROM pairs p JOIN words x ON x.word = p.a JOIN words y ON y.word = p.b, total)"""


def _turns(s, d):
    t = v.table(s, d, "conversations").where("text is not null")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"), T.words(F.col("text"))


@query("a16_window_counts", TURNS + " SELECT a, b, n FROM pairs")
def a16(s, d):
    docs, w = _turns(s, d)
    return X.window_counts(docs, w)[1]


@query("a17_pmi", TURNS + " SELECT a, b, round(weight, 6) AS weight FROM pmi WHERE weight > 0")
def a17(s, d):
    docs, w = _turns(s, d)
    words, pairs = X.window_counts(docs, w)
    total = docs.select(F.size(T.windows(w, 20)).alias("k")).agg(F.sum("k").alias("total"))
    return X.pmi(words, pairs, total).select("a", "b", F.round("weight", 6).alias("weight"))


@query("a18_document_word_edges", TURNS + ", tf AS (SELECT doc_id, f AS feature, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS f FROM turns) GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM tf GROUP BY feature) SELECT doc_id, feature, round(tf * ln((SELECT count(*) FROM turns) / df), 6) AS value FROM tf JOIN df USING (feature)")
def a18(s, d):
    docs, w = _turns(s, d)
    tf = X.term_counts(docs, w)
    return X.tfidf(tf, tf, docs.agg(F.count("*").alias("total")), "graph", normalise=False).select("doc_id", "feature", F.round("value", 6).alias("value"))


GRAPH = TURNS + """, tf AS (SELECT doc_id, f AS feature, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS f FROM turns) GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM tf GROUP BY feature),
    e AS (SELECT 'word' AS src_type, 'word' AS dst_type, weight FROM pmi WHERE weight > 0 UNION ALL SELECT 'doc', 'word', tf * ln((SELECT count(*) FROM turns) / df) FROM tf JOIN df USING (feature))
    SELECT src_type, dst_type, count(*) AS edges, round(sum(weight), 2) AS weight FROM e GROUP BY ALL"""


@query("a19_text_graph", GRAPH)
def a19(s, d):
    docs, w = _turns(s, d)
    return X.text_graph(docs, w).groupBy("src_type", "dst_type").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 2).alias("weight"))


NODES = TURNS + """, tf AS (SELECT doc_id, f AS feature, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS f FROM turns) GROUP BY ALL), df AS (SELECT feature, count(*) AS df FROM tf GROUP BY feature),
    named AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS part, doc_id AS id, NULL AS word FROM turns UNION ALL SELECT 1, NULL, feature FROM df),
    nodes AS (SELECT part, id, word, row_number() OVER (ORDER BY part, id, word) - 1 AS node FROM named)"""


@query("a19_graph_nodes", NODES + " SELECT CASE WHEN part = 1 THEN 'word' ELSE 'doc' END AS node_type, coalesce(word, id::VARCHAR) AS name, node FROM nodes")
def a19b(s, d):
    docs, w = _turns(s, d)
    return X.graph_nodes(docs, w, F.col("doc_id") % 4 == 0)


@query("t29_graph_edges", NODES + """ SELECT a.node AS src, b.node AS dst, round(weight, 6) AS weight FROM pmi JOIN nodes a ON a.word = pmi.a JOIN nodes b ON b.word = pmi.b WHERE weight > 0
    UNION ALL SELECT a.node, b.node, round(tf * ln((SELECT count(*) FROM turns) / df), 6) FROM tf JOIN df USING (feature) JOIN nodes a ON a.id = doc_id JOIN nodes b ON b.word = feature""")
def t29(s, d):
    docs, w = _turns(s, d)
    nodes = stage(X.graph_nodes(docs, w, F.col("doc_id") % 4 == 0), "nodes")
    texts = stage(X.numbered_texts(docs, w, nodes), "texts")
    return X.numbered_graph(texts, nodes).select("src", "dst", F.round("weight", 6).alias("weight"))


# --- scores and dense vectors ---------------------------------------------------------------------------------------


@query("f14_sigmoid_and_log", with_views("SELECT doc_id, label, round(1 / (1 + exp(-score)), 6) AS p, round(ln(score + 0.00001), 6) AS l FROM scores", "scores"))
def f14(s, d):
    return v.scores(s, d).select("doc_id", "label", F.round(S.sigmoid(F.col("score")), 6).alias("p"), F.round(S.safe_log(F.col("score")), 6).alias("l"))


@query("f15_softmax", with_views("SELECT key, label, round(exp(n / 100 - max(n / 100) OVER w) / sum(exp(n / 100)) OVER w * exp(max(n / 100) OVER w), 6) AS p FROM key_counts WINDOW w AS (PARTITION BY key)", "key_counts"))
def f15(s, d):
    return v.key_counts(s, d).select("key", "label", F.round(S.softmax(F.col("n") / 100, "key"), 6).alias("p"))


@query("f16_normalised_sigmoid", with_views("SELECT doc_id, label, round(1 / (1 + exp(-score)) / sum(1 / (1 + exp(-score))) OVER (PARTITION BY doc_id), 6) AS p FROM scores", "scores"))
def f16(s, d):
    return v.scores(s, d).select("doc_id", "label", F.round(S.normalised_sigmoid(F.col("score"), "doc_id"), 6).alias("p"))


@query("f17_cosine_to_centroid", """WITH c AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM c GROUP BY ALL)
    SELECT vec_id AS id, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 6) AS similarity FROM c JOIN m USING (label, i) GROUP BY vec_id""")
def f17(s, d):
    e = v.vectors(s, d)
    means = V.mean_vectors(e.select("label", "vector"), "label").select("label", F.col("vector").alias("m"))
    return e.join(means, "label").select("id", F.round(S.cosine(F.col("vector"), F.col("m")), 6).alias("similarity"))


@query("f13_weighted_mean", "WITH c AS (SELECT label, vec_id % 3 AS w, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) SELECT label, i::INTEGER AS i, round(sum(x * w) / sum(w), 6) AS x FROM c GROUP BY ALL")
def f13(s, d):
    e = v.vectors(s, d).select("label", "vector", (F.col("id") % 3).alias("w"))
    return V.mean_vectors(e, "label", F.col("w").cast("double")).select("label", F.posexplode("vector").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("f18_multi_hot", with_views("SELECT doc_id, array_to_string([(list_contains(l, i))::INTEGER FOR i IN range(0, (SELECT max(CAST(substr(label, 7) AS BIGINT)) + 1 FROM order_labels))], '') AS hot FROM (SELECT doc_id, list(CAST(substr(label, 7) AS BIGINT)) AS l FROM order_labels GROUP BY doc_id)", "order_labels"))
def f18(s, d):
    ids = v.order_labels(s, d).groupBy("doc_id").agg(F.collect_set(F.expr("cast(substr(label, 7) as int)")).alias("l"))
    width = v.order_labels(s, d).agg(F.max(F.expr("cast(substr(label, 7) as int)"))).first()[0]
    return ids.select("doc_id", F.array_join(F.transform(S.multi_hot(F.col("l"), (width or 0) + 1), lambda x: x.cast("string")), "").alias("hot"))


@query("f19_label_strings", "SELECT n_nationkey AS id, '__label__' || replace(trim(n_name || ' x'), ' ', '_') AS label FROM nation UNION ALL SELECT p_partkey, '__label__' || replace(trim(p_name), ' ', '_') FROM part")
def f19(s, d):
    rows = v.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit(" x")).alias("x")).unionByName(v.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("x")))
    return rows.select("id", F.trim(T.label_line(F.array("x"), F.lit(""))).alias("label"))


@query("f22_json_predictions", with_views("SELECT doc_id, '[' || string_agg('{\"label\":\"' || label || '\",\"rank\":' || rank || '}', ',' ORDER BY rank) || ']' AS predict FROM top5 GROUP BY doc_id", "top5"))
def f22(s, d):
    p = v.top5(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("p"))
    return p.select("doc_id", F.to_json(F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["rank"].alias("rank")))).alias("predict"))


@query("f23_prediction_maps", with_views("SELECT doc_id, max(CASE WHEN rank = 1 THEN label END) AS best, max(score) AS score, count(*)::INTEGER AS n FROM top5 GROUP BY doc_id", "top5"))
def f23(s, d):
    from bramble.operators import topk

    maps = topk.packed(v.top5(s, d)).select("doc_id", topk.score_map(F.col("predict")).alias("m"))
    return maps.select("doc_id", F.map_keys("m")[0].alias("best"), F.array_max(F.map_values("m")).alias("score"), F.size("m").alias("n"))


def _word_vectors(s, d, dim=4):
    words = v.tokens(s, d).select("token").distinct()
    return words.select("token", V.hashed_vector(F.col("token"), dim).alias("vector"))


HV = "('0x' || substr(md5('42|' || {t} || '|' || i), 1, 8))::BIGINT / 4294967296 * 2 - 1"


@query("f11_sentence_vectors", with_views(f"""WITH wv AS (SELECT token, i, ({HV.format(t='token')}) / 4 AS x FROM (SELECT DISTINCT token FROM tokens), (SELECT unnest([1, 2, 3, 4]) AS i)), u AS (SELECT token, i, x / sqrt(sum(x * x) OVER (PARTITION BY token)) AS x FROM wv)
    SELECT doc_id, round(avg(CASE WHEN i = 1 THEN x END), 5) AS first, round(sqrt(power(avg(CASE WHEN i = 1 THEN x END), 2) + power(avg(CASE WHEN i = 2 THEN x END), 2) + power(avg(CASE WHEN i = 3 THEN x END), 2) + power(avg(CASE WHEN i = 4 THEN x END), 2)), 5) AS norm FROM tokens JOIN u USING (token) GROUP BY doc_id""", "tokens"))
def f11(s, d):
    m = V.sentence_vectors(v.tokens(s, d).select("doc_id", "token"), _word_vectors(s, d), dim=4)
    return m.select("doc_id", F.round(F.col("vector")[0], 5).alias("first"), F.round(S.norm(F.col("vector")), 5).alias("norm"))


@query("f12_graph_document_vectors", with_views(f"""WITH wv AS (SELECT token, ({HV.format(t='token').replace("|| i)", "|| 1)")}) / 4 AS x FROM (SELECT DISTINCT token FROM tokens WHERE length(token) > 3)) SELECT doc_id, round(coalesce(sum(x), 0) / count(*), 6) AS first FROM tokens LEFT JOIN wv USING (token) GROUP BY doc_id""", "tokens"))
def f12(s, d):
    t = v.tokens(s, d).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    known = _word_vectors(s, d).where(F.length("token") > 3)
    zero = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.lit(0.0))
    rows = t.join(known, "token", "left").select("doc_id", "n", F.coalesce("vector", zero).alias("vector"))
    return V.mean_vectors(rows, "doc_id", F.col("n"), dim=4).select("doc_id", F.round(F.col("vector")[0], 6).alias("first"))


@query("f10_subword_vectors", with_views(f"""WITH g AS (SELECT token, unnest([substr('<' || token || '>', i, 3) FOR i IN range(1, length(token) + 1)]) AS gram FROM (SELECT DISTINCT token FROM tokens)) SELECT token AS word, round(avg(({HV.format(t='gram').replace("|| i)", "|| 1)")}) / 4), 6) AS first FROM g GROUP BY token""", "tokens"))
def f10(s, d):
    words = v.tokens(s, d).select(F.col("token").alias("word")).distinct()
    grams = words.select(F.explode(T.char_ngrams(F.col("word"), 3, 3)).alias("gram")).distinct().select("gram", V.hashed_vector(F.col("gram"), 4).alias("vector"))
    return V.subword_vectors(words, grams, 3, 3, dim=4).select("word", F.round(F.col("vector")[0], 6).alias("first"))


@query("f24_ngram_vectors", with_views(f"""WITH g AS (SELECT token, unnest([substr('<' || token || '>', i, 3) FOR i IN range(1, length(token) + 1)]) AS gram FROM (SELECT DISTINCT token FROM tokens)) SELECT token AS word, gram, round(({HV.format(t='gram').replace("|| i)", "|| 1)")}) / 4, 6) AS first FROM g""", "tokens"))
def f24(s, d):
    words = v.tokens(s, d).select(F.col("token").alias("word")).distinct()
    grams = words.select("word", F.explode(T.char_ngrams(F.col("word"), 3, 3)).alias("gram"))
    return grams.select("word", "gram", F.round(V.hashed_vector(F.col("gram"), 4)[0], 6).alias("first"))


@query("f20_document_vectors", with_views(f"""WITH wv AS (SELECT feature, i, ({HV.format(t='feature')}) / 4 AS x FROM (SELECT DISTINCT feature FROM order_features), (SELECT unnest([1, 2]) AS i)) SELECT doc_id, i::INTEGER AS i, round(sum(value * x) / sum(value), 6) AS x FROM order_features JOIN wv USING (feature) GROUP BY ALL""", "order_features"))
def f20(s, d):
    f = v.order_features(s, d)
    wv = f.select("feature").distinct().select("feature", F.slice(V.hashed_vector(F.col("feature"), 4), 1, 2).alias("vector"))
    m = V.mean_vectors(f.join(wv, "feature"), "doc_id", F.col("value"), dim=2)
    return m.select("doc_id", F.posexplode("vector").alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("i"), F.round("x", 6).alias("x"))
