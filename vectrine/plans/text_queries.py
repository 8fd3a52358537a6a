"""Queries over texts: corpora, chats, lexical rules and keys."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectrine.functions import text as X
from vectrine.functions.lexicon import NEUTRAL_BANS, TOPIC_STOPS, forbidden, terms_of
from vectrine.operators import tokens as K
from vectrine.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


ROLE_SQL = "CASE lower(role) WHEN 'user' THEN 'Human' WHEN 'human' THEN 'Human' WHEN 'assistant' THEN 'Assistant' WHEN 'gpt' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE upper(substr(role, 1, 1)) || lower(substr(role, 2)) END"
CHAT = f"c AS (SELECT conv_id, string_agg({ROLE_SQL} || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS chat, count(*) AS turns FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id)"


def chats(spark, sf_dir):
    """Turns of a conversation as one transcript; blank turns are dropped."""
    c = table(spark, sf_dir, "conversations").where(X.blank_to_null(F.col("text")).isNotNull())
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(X.role_name(F.col("role")), F.lit(": "), F.col("text")).alias("line"))))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t.line), "\n\n").alias("chat"), F.count(F.lit(1)).alias("turns"))


@query(f"WITH {CHAT} SELECT * FROM c")
def chat_render(spark, sf_dir):
    return chats(spark, sf_dir)


@query(f"WITH {CHAT} SELECT conv_id, contains(chat, 'Human:') AND contains(chat, 'Assistant:') AS valid FROM c")
def dialogue_validity(spark, sf_dir):
    return chats(spark, sf_dir).select("conv_id", X.is_dialogue(F.col("chat")).alias("valid"))


@query(f"""WITH {CHAT}, p AS (SELECT conv_id, replace(replace(chat, 'Human:', 'Person:'), 'Assistant:', ' AI:') AS t FROM c)
SELECT conv_id, sha256(regexp_replace(regexp_replace(t, '(?m)^(\\s*)Person:', '\\1Human:', 'g'), '(?m)^(\\s*)AI:', '\\1Assistant:', 'g')) AS sha FROM p""")
def speaker_tags(spark, sf_dir):
    p = chats(spark, sf_dir).withColumn("t", F.replace(F.replace("chat", F.lit("Human:"), F.lit("Person:")), F.lit("Assistant:"), F.lit(" AI:")))
    return p.select("conv_id", F.sha2(X.speakers(F.col("t")), 256).alias("sha"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(list_slice(string_split(text, '. '), 2, 100000), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1:5] AS p FROM documents)
SELECT doc_id, i - 1 AS part, p[i] AS text FROM s, range(1, 6) t(i) WHERE i <= len(p)""")
def delimited_split(spark, sf_dir):
    """Parts after the first delimiter, at most five, with their ordinal among the non-empty."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(X.delimited_parts(F.col("text"), ". ", 5)).alias("part", "text")).withColumn("part", F.col("part").cast("long"))


TERMS = ("the", "and", "de", "und", "idiot", "mood", "license", "rights reserved")
_HAS = lambda t: f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z]){t}($|[^a-z])') THEN '{t}' END"


@query(f"SELECT doc_id, coalesce(array_to_string(list_sort(list_filter([{', '.join(map(_HAS, TERMS))}], lambda x: x IS NOT NULL)), ','), '') AS terms FROM documents")
def lexical_hits(spark, sf_dir):
    """Forbidden terms between non-letters, sorted."""
    return table(spark, sf_dir, "documents").select("doc_id", X.terms_found(F.col("text"), TERMS).alias("terms"))


_ANY = lambda ts: " OR ".join(f"regexp_matches(lower(text), '(^|[^a-z]){t}($|[^a-z])')" for t in ts)


@query(f"SELECT doc_id, CASE WHEN {_ANY(['idiot', 'moron'])} THEN 'reject' WHEN {_ANY(NEUTRAL_BANS)} OR {_ANY(['license'])} THEN 'warn' ELSE 'ok' END AS verdict FROM documents")
def lexical_policy(spark, sf_dir):
    """Exact target labels are rejected; generic bans and synonyms give a warning."""
    has = lambda ts: F.greatest(*[X.has_term(F.col("text"), t) for t in ts])
    verdict = F.when(has(["idiot", "moron"]), "reject").when(has([*NEUTRAL_BANS, "license"]), "warn").otherwise("ok")
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


_FIRST = "'The mood was ' || (CASE doc_id % 4 WHEN 0 THEN 'sad and full of grief' WHEN 1 THEN 'content; thanks' WHEN 2 THEN 'Angry, at ease' ELSE 'madder' END) || '. ' || coalesce(text, '')"
_LISTED = lambda text, labels, neutral: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({text}), '(^|[^a-z]){t}($|[^a-z])') THEN '{t}' END" for t in terms_of(labels, neutral)) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT doc_id, coalesce({_LISTED('t', ['angry', 'sad', 'content', 'relaxed'], False)}, '') AS story, coalesce({_LISTED('t', ['angry', 'sad', 'content', 'relaxed'], True)}, '') AS neutral FROM (SELECT doc_id, {_FIRST} AS t FROM documents)")
def forbidden_terms(spark, sf_dir):
    """Labels and synonyms that a whole text names, behind a planted sentence, as in a story and as in a neutral text."""
    d = F.col("doc_id") % 4
    said = F.when(d == 0, "sad and full of grief").when(d == 1, "content; thanks").when(d == 2, "Angry, at ease").otherwise("madder")
    t = F.concat(F.lit("The mood was "), said, F.lit(". "), F.coalesce("text", F.lit("")))
    labels = ["angry", "sad", "content", "relaxed"]
    return table(spark, sf_dir, "documents").select("doc_id", forbidden(t, labels).alias("story"), forbidden(t, labels, neutral=True).alias("neutral"))


@query("""SELECT item_id AS id, sha256(coalesce(CASE WHEN item_id % 3 = 0 AND regexp_matches(text, '\\S') THEN text END, CASE WHEN item_id % 3 = 1 AND regexp_matches(text, '\\S') THEN 'Human: What is item ' || item_id || '?' || chr(10) || chr(10) || 'Assistant: ' || text END, 'none')) AS sha FROM benchmark""")
def row_to_text(spark, sf_dir):
    """Heterogeneous rows: the first field that is not blank wins; direct text keeps its white space, a prompt and answer become a chat."""
    t, k = F.col("text"), F.col("item_id") % 3
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("id"), F.when(k == 0, t).alias("direct"), F.when(k == 1, F.concat(F.lit("What is item "), F.col("item_id"), F.lit("?"))).alias("prompt"), F.when(k == 1, t).alias("answer")
    )
    pair = F.concat(F.lit("Human: "), "prompt", F.lit("\n\nAssistant: "), X.blank_to_null(F.col("answer")))
    return rows.select("id", F.sha2(F.coalesce(X.blank_to_null(F.col("direct")), pair, F.lit("none")), 256).alias("sha"))


@query("SELECT coalesce(CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR END, CASE WHEN page_id % 3 = 0 THEN url END, 'row-' || page_id) AS document_id, page_id FROM pages")
def document_ids(spark, sf_dir):
    """Identifier by precedence: own id, url, row number."""
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(F.coalesce(F.when(p % 2 == 0, p.cast("string")), F.when(p % 3 == 0, F.col("url")), F.concat(F.lit("row-"), p)).alias("document_id"), "page_id")


TOKENS = "t AS (SELECT doc_id, i - 1 AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents)))"


def words_of(docs, *keep):
    """doc_id, words (the white-space tokens) and columns to keep of each text; rows without a text are left out."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return docs.where("text is not null").select("doc_id", *keep, words.alias("words"))


def tokens_of(docs, *keep):
    """One row per white-space token: doc_id, pos, token and columns to keep."""
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return docs.select("doc_id", *keep, F.posexplode(words).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


def tokens(spark, sf_dir):
    return tokens_of(table(spark, sf_dir, "documents"))


@query(f"WITH {TOKENS}, v AS (SELECT DISTINCT regexp_replace(lower(token), '[^a-z]', '', 'g') AS w FROM t), k(term) AS (VALUES ('the'), ('tion'), ('ment'), ('heit')) SELECT term, count(*) AS words, min(w) AS first FROM v, k WHERE length(w) >= 3 AND (contains(w, term) OR contains(term, w)) GROUP BY term")
def token_relatedness(spark, sf_dir):
    """Distinct vocabulary words that hold a term or are held by it. The terms are few and fixed."""
    v = tokens(spark, sf_dir).select(X.token_letters(F.col("token")).alias("w")).distinct()
    terms = F.explode(F.array(*map(F.lit, ("the", "tion", "ment", "heit"))))
    return v.withColumn("term", terms).where(X.related(F.col("w"), F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("words"), F.min("w").alias("first"))


@query(f"WITH {TOKENS}, h AS (SELECT token, cast(('0x' || substr(sha256(token), 1, 8)) AS BIGINT) % 500 AS bucket FROM t) SELECT bucket, count(*) AS tokens, count(DISTINCT token) AS words FROM h GROUP BY bucket")
def token_hash_buckets(spark, sf_dir):
    h = tokens(spark, sf_dir).withColumn("bucket", F.conv(F.substring(F.sha2("token", 256), 1, 8), 16, 10).cast("long") % 500)
    return h.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words"))


@query("""WITH w AS (SELECT source, doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x NOT IN (STOPS)) AS w FROM documents),
b AS (SELECT source, w[i] || ' ' || w[i + 1] AS bigram FROM (SELECT source, w, unnest(range(1, len(w))) AS i FROM w)), c AS (SELECT source, bigram, count(*) AS n FROM b GROUP BY ALL)
SELECT source, bigram, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, bigram) AS rank FROM c) WHERE rank <= 5""".replace("STOPS", ", ".join(f"'{w}'" for w in TOPIC_STOPS)))
def topic_bigrams(spark, sf_dir):
    """The five most frequent pairs of neighbouring content words of each source."""
    counts = K.pair_counts(table(spark, sf_dir, "documents"), "text", TOPIC_STOPS, "source")
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n"), "bigram"))
    return counts.withColumn("rank", rank.cast("long")).where("rank <= 5")


@query("""SELECT doc_id, CASE WHEN instr(text, 'tion') > 0 THEN substr(text, greatest(instr(text, 'tion') - 20, 1), instr(text, 'tion') - greatest(instr(text, 'tion') - 20, 1)) || '**tion**' || substr(text, instr(text, 'tion') + 4, 20) END AS snippet FROM documents""")
def context_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text"), F.lit("tion"), 20).alias("snippet"))


@query("SELECT conv_id, turn, sha256(to_json({question: role, response: text})) AS sha FROM conversations")
def canonical_json_hash(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.canonical_sha(F.col("role").alias("question"), F.col("text").alias("response")).alias("sha"))


@query("SELECT printf('%s-%03d-%s', lang, doc_id % 1000, substr(sha256(text), 1, 16)) AS response_id, printf('%s:t%02d:s%02d', source, doc_id % 20, doc_id // 20 % 100) AS example_id, CASE WHEN doc_id % 20 < 10 THEN 'A' ELSE 'B' END AS split, doc_id FROM documents")
def example_ids(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.format_string("%s-%03d-%s", "lang", d % 1000, F.substring(F.sha2("text", 256), 1, 16)).alias("response_id"),
        F.format_string("%s:t%02d:s%02d", "source", d % 20, F.floor(d / 20) % 100).alias("example_id"),
        F.when(d % 20 < 10, "A").otherwise("B").alias("split"),
        "doc_id",
    )


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('17:' || doc_id)) AS place FROM documents QUALIFY place <= 50")
def seeded_shuffle(spark, sf_dir):
    """A shuffle within groups that any layout of the rows repeats; its first fifty."""
    place = F.row_number().over(W.partitionBy("lang").orderBy(X.shuffle_key(17, F.col("doc_id"))))
    return table(spark, sf_dir, "documents").select("lang", "doc_id", place.cast("long").alias("place")).where("place <= 50")


@query("SELECT doc_id, CASE WHEN cast(('0x' || substr(sha256('split:' || doc_id), 1, 8)) AS BIGINT) % 10 = 0 THEN 'held_out' ELSE 'train' END AS part FROM documents")
def hold_out_split(spark, sf_dir):
    bucket = F.conv(F.substring(X.shuffle_key("split", F.col("doc_id")), 1, 8), 16, 10).cast("long") % 10
    return table(spark, sf_dir, "documents").select("doc_id", F.when(bucket == 0, "held_out").otherwise("train").alias("part"))


@query("""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)),
q AS (SELECT source, 250 // n + CASE WHEN k < 250 % n THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT d.source, doc_id, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS rn FROM documents d WHERE regexp_matches(text, '\\S')) SELECT r.source, doc_id, rn FROM r JOIN q USING (source) WHERE rn <= quota""")
def balanced_source_cap(spark, sf_dir):
    """A global cap dealt evenly over sources; the first sources get the remainder, blank texts don't count."""
    from vectrine.sources.corpora import balanced_cap

    return balanced_cap(table(spark, sf_dir, "documents"), 250, "source", "doc_id").select("source", "doc_id", F.col("rank").alias("rn"))


@query("WITH c AS (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 500) SELECT doc_id, length(substr(text, 1, 2000)) AS n, sha256(substr(text, 1, 2000)) AS sha FROM c WHERE length(text) > 100")
def capped_stream_filter(spark, sf_dir):
    """The cap counts rows before the length filter; texts are cut afterwards."""
    c = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(500).where(F.length("text") > 100)
    t = F.substring("text", 1, 2000)
    return c.select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha"))


@query("SELECT doc_id, n_chars <= 500 AS short, CASE WHEN n_chars <= 500 THEN n_chars // 2 ELSE 500 END AS begin FROM documents")
def short_text_plan(spark, sf_dir):
    """Where reading starts: short texts start halfway."""
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", (n <= 500).alias("short"), F.when(n <= 500, F.floor(n / 2)).otherwise(F.lit(500)).cast("long").alias("begin"))


@query(f"WITH {TOKENS}, m AS (SELECT doc_id, pos, pos % 3 <> 0 AS mask FROM t), o AS (SELECT *, sum(mask::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS ordinal FROM m) SELECT doc_id, count(*) AS eligible, min(pos) AS first FROM o WHERE mask AND ordinal >= 10 GROUP BY doc_id")
def eligible_tokens(spark, sf_dir):
    """Tokens from the eleventh valid one on, whichever side the padding is on; found by ordinals of valid tokens."""
    words = words_of(table(spark, sf_dir, "documents"))
    valid = F.filter(F.transform("words", lambda _, i: i.cast("long")), lambda i: i % 3 != 0)
    o = words.select("doc_id", F.slice(valid, 11, F.greatest(F.size(valid) - 10, F.lit(0))).alias("at")).where(F.size("at") > 0)
    return o.select("doc_id", F.size("at").cast("long").alias("eligible"), F.element_at("at", 1).alias("first"))


@query(f"WITH {TOKENS}, b AS (SELECT doc_id, min(pos) FILTER (token IN ('the', 'de', 'la', 'der')) AS hit, count(*) AS n FROM t GROUP BY doc_id) SELECT doc_id, coalesce(hit, -1) AS boundary, CASE WHEN hit IS NULL THEN n ELSE hit END AS masked FROM b")
def response_label_mask(spark, sf_dir):
    """Everything before the first boundary token is masked; all of it where there is none."""
    places = F.transform("words", lambda w, i: F.when(w.isin("the", "de", "la", "der"), i.cast("long")))
    b = words_of(table(spark, sf_dir, "documents")).select("doc_id", F.array_min(places).alias("at"), F.size("words").cast("long").alias("n"))
    return b.select("doc_id", F.coalesce("at", F.lit(-1).cast("long")).alias("boundary"), F.coalesce("at", "n").alias("masked"))


@query("WITH n AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'model.layers.' || vec_id % 48 || '.mlp' WHEN 1 THEN 'base.' || vec_id % 7 || '.x' ELSE 'embed' END AS name FROM embeddings) SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN vec_id % 48 WHEN 1 THEN vec_id % 7 ELSE -1 END AS layer FROM n")
def layer_numbers(spark, sf_dir):
    v = F.col("vec_id")
    name = F.when(v % 3 == 0, F.concat(F.lit("model.layers."), v % 48, F.lit(".mlp"))).when(v % 3 == 1, F.concat(F.lit("base."), v % 7, F.lit(".x"))).otherwise(F.lit("embed"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(X.layer_number(name), F.lit(-1).cast("long")).alias("layer"))


@query("SELECT vec_id, round((80 * exp(-0.5::DOUBLE) + (vec_id % 100) * exp(-2.0::DOUBLE)) / (exp(-0.5::DOUBLE) + exp(-2.0::DOUBLE)), 8) AS score FROM embeddings")
def logprob_score(spark, sf_dir):
    """Expected judge score from the log-probabilities of answer tokens; keys that are no whole number don't count."""
    v = F.col("vec_id") % 100
    rest = (F.lit("n/a"), F.lit(-1.0), F.lit("101"), F.lit(-0.1))
    m = F.when(v == 80, F.create_map(F.lit("80"), F.lit(-0.5), *rest)).otherwise(F.create_map(F.lit("80"), F.lit(-0.5), F.when(v == 80, "-").otherwise(v.cast("string")), F.lit(-2.0), *rest))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(X.expected_score(m), 8).alias("score"))


@query("SELECT doc_id, n_chars, CASE WHEN n_chars <= 300 THEN 'low' WHEN n_chars <= 1500 THEN 'mid' ELSE 'high' END AS bin FROM documents")
def right_closed_bins(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", X.binned(F.col("n_chars"), [300, 1500], ["low", "mid", "high"]).alias("bin"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), f AS (SELECT * FROM c, (VALUES (0.5::DOUBLE), (0.66), (1.0)) t(share))
SELECT label, share, n, greatest(0, least(n - 1, round_even(share * n, 0)::BIGINT)) AS layer FROM f""")
def primary_layers(spark, sf_dir):
    """The layer at a share of the depth, where each label's vectors stand for its layers."""
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    at = F.array(*[F.struct(F.lit(x).alias("share"), X.primary_layer(x, F.col("n")).alias("layer")) for x in (0.5, 0.66, 1.0)])
    return c.select("label", "n", F.explode(at).alias("x")).select("label", "x.share", "n", "x.layer")


@query("""SELECT event_id, CASE WHEN value IS NULL OR isnan(value) OR isinf(value) THEN '—' WHEN abs(value) > 0 AND abs(value) < 0.001 THEN printf('%.2e', value) ELSE printf('%.3f', value) END AS shown FROM events""")
def metric_text(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.number_text(F.col("value")).alias("shown"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS sha FROM pages")
def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(X.escaped(F.col("html")), 256).alias("sha"))


ESCAPED_SQL = "replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(rf"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, list_transform(w, lambda t: CASE WHEN length(t) > 9 THEN '<mark>' || {ESCAPED_SQL} || '</mark>' ELSE {ESCAPED_SQL} END) AS h, len(list_filter(w, lambda t: length(t) > 9)) AS marked FROM w)
SELECT doc_id, marked, sha256(array_to_string(h, ' ')) AS sha FROM e""")
def highlighted_tokens(spark, sf_dir):
    """Each text as HTML whose long tokens are marked."""
    d = words_of(table(spark, sf_dir, "documents"))
    lengths = F.transform("words", F.length)
    html = X.highlighted(F.col("words"), lengths, 9)
    return d.select("doc_id", F.size(F.filter(lengths, lambda n: n > 9)).cast("long").alias("marked"), F.sha2(html, 256).alias("sha"))


@query("""SELECT doc_id, CASE WHEN doc_id % 8 < 3 THEN 'true' WHEN doc_id % 8 < 7 THEN 'false' ELSE 'none' END AS flag FROM documents""")
def boolean_normaliser(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("true", "1", " YES ", "False", "0", "no", "", "maybe"))), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(X.boolean(raw).cast("string"), F.lit("none")).alias("flag"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN (doc_id % 101)::DOUBLE END AS score FROM documents")
def judge_values(spark, sf_dir):
    """Quoted numbers are numbers; other text and NaN are null."""
    d = F.col("doc_id")
    raw = F.when(d % 4 == 0, F.concat(F.lit("'"), d % 101, F.lit("'"))).when(d % 4 == 1, (d % 101).cast("string")).when(d % 4 == 2, F.lit("REFUSAL")).otherwise(F.lit("NaN"))
    return table(spark, sf_dir, "documents").select("doc_id", X.judge_value(raw).alias("score"))
