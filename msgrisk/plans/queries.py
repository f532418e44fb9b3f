"""Registered queries of the message-risk engine and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.functions import canonical as C
from msgrisk.functions import lexicons as L
from msgrisk.functions import signals as S
from msgrisk.functions.urls import LABEL, Suffixes, deceptive, hosts, official, url_pattern
from msgrisk.operators import corpus, evaluate, evasion, importer, score, vectorize
from msgrisk.plans.messages import SUFFIXES, messages, messages_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def hit(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit('(?i)' + pattern)})"


def words(col: str, ws: list[str]) -> str:
    return hit(col, L.any_word(ws))


def num(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suffixes() -> Suffixes:
    return Suffixes.of(SUFFIXES)


M = messages_sql()
DIGITS = "(?:[0-9]{3}|[03-9][0-9]{3}|1[0-8][0-9]{2}|2[1-9][0-9]{2}|[0-9]{5})"
CUE = r"\b(?:" + "|".join(rf"{c}\b[\s:,\-]{{0,{24 - len(c)}}}" for c in "to on at via dial call calling sms text contact reply ku kuno kwa pa fonerai tumirai thumela".split()) + ")"
SHORT = hit("text", f"{CUE}{DIGITS}([^0-9]|$)")
FULL = hit("text", "[0-9]{9,}")


def asked(ws: list[str], cue: bool) -> str:
    more = f" AND {words('s', L.REQUEST_CUES)}" if cue else ""
    return f"len(list_filter(string_split_regex(lower(text), '[.!?]'), lambda s: {words('s', ws)} AND NOT {words('s', L.NEGATION)}{more})) > 0"


# links: candidates are label chains, kept if they end in a listed suffix
_ENDS = "|".join(L.quoted(s) for s in sorted(SUFFIXES, key=lambda s: -len(s)))
_URL = lit(rf"(?i)https?://\S+|(?:^|[^\w.@-])(?:www\.\S+|(?:{LABEL}\.)+(?:{_ENDS})(?:/\S*)?\b)|www\.\S+")
_FOUND = f"list_transform(regexp_extract_all(text, {_URL}), lambda u: regexp_replace(u, '^[^a-zA-Z0-9]', ''))"
_HOST = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(u), '^https?://', ''), '[/?#].*$', ''), '^.*@', ''), ':.*$', ''), '^www\.', ''), '\.+$', '')"
)
HOSTS = f"list_filter(list_transform({_FOUND}, lambda u: {_HOST}), lambda h: h <> '')"
_EXACT = "|".join(L.quoted(d) for d in L.OFFICIAL_DOMAINS)
_TAIL = "|".join(L.quoted(d) for d in L.OFFICIAL_SUFFIXES)
OFFICIAL = f"regexp_matches(h, {lit(rf'(?:^|\.)(?:{_EXACT})$|(?:{_TAIL})$')})"
WITH_HOSTS = f"WITH m AS ({M}), h AS (SELECT *, {HOSTS} AS hosts FROM m)"


@register(f"SELECT msg_id, {num(SHORT)} AS has_shortcode, {num(FULL)} AS has_full_number, {num(hit('text', L.CURRENCY))} AS has_currency_amount, CAST(len(regexp_extract_all(lower(text), {lit(L.any_word(L.URGENCY))})) AS DOUBLE) AS urgency_word_count FROM ({M})")
def signals_core(spark, sf_dir):
    m, t = messages(spark, sf_dir), F.col("text")
    return m.select("msg_id", S.shortcode(t).cast("double").alias("has_shortcode"), t.rlike(L.FULL_NUMBER).cast("double").alias("has_full_number"), S.has(t, L.CURRENCY).cast("double").alias("has_currency_amount"), F.regexp_count(F.lower(t), F.lit(L.any_word(L.URGENCY))).cast("double").alias("urgency_word_count"))


@register(f"SELECT msg_id, {asked(L.CREDENTIALS, True)} AS credentials, ({asked(L.VERIFY_VERBS, False)}) OR ({asked(L.VERIFY_NOUNS, True)}) AS identity, {asked(L.PERSONAL_ID, True)} AS personal_id, {words('text', L.CREDENTIALS)} AS mentioned FROM ({M})")
def signals_requests(spark, sf_dir):
    low = F.lower("text")
    return messages(spark, sf_dir).select("msg_id", S.requested(low, L.CREDENTIALS, True).alias("credentials"), (S.requested(low, L.VERIFY_VERBS, False) | S.requested(low, L.VERIFY_NOUNS, True)).alias("identity"), S.requested(low, L.PERSONAL_ID, True).alias("personal_id"), S.mentioned("requests_sensitive_credentials", F.col("text")).alias("mentioned"))


def with_hosts(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("hosts", hosts(F.col("text"), suffixes()))


@register(f"{WITH_HOSTS} SELECT msg_id, array_to_string(hosts, ',') AS hosts, regexp_matches(text, {_URL}) AS has_url, len(list_filter(hosts, lambda h: h IN ({', '.join(map(lit, L.SHORTENERS))}))) > 0 AS shortener, len(list_filter(hosts, lambda h: NOT {OFFICIAL})) > 0 AS unofficial FROM h")
def url_hosts(spark, sf_dir):
    h = F.col("hosts")
    return with_hosts(spark, sf_dir).select("msg_id", F.array_join(h, ",").alias("hosts"), F.col("text").rlike(url_pattern(suffixes())).alias("has_url"), F.exists(h, lambda x: x.isin(L.SHORTENERS)).alias("shortener"), F.exists(h, lambda x: ~official(x)).alias("unofficial"))


@register("SELECT page_id, lower(regexp_extract(url, '^https?://(?:www\\.)?([^/?#:]+)', 1)) AS host FROM pages WHERE url IS NOT NULL")
def url_hosts_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.col("url").isNotNull()).select("page_id", F.try_element_at(hosts(F.col("url"), suffixes()), F.lit(1)).alias("host"))


@register(f"{WITH_HOSTS} SELECT msg_id, {words('text', L.BRANDS)} AND (len(list_filter(hosts, lambda h: {OFFICIAL})) > 0 OR {SHORT}) AS trusted, {words('text', L.BRANDS)} AND (len(list_filter(hosts, lambda h: NOT {OFFICIAL})) > 0 OR {FULL}) AS untrusted, len(list_filter(hosts, lambda h: NOT {OFFICIAL} AND regexp_matches(h, {lit('|'.join(L.quoted(b) for b in L.BRANDS))}))) > 0 AS lookalike FROM h")
def signals_brand_channel(spark, sf_dir):
    df = S.with_signals(messages(spark, sf_dir), suffixes(), is_canonical=True)
    return df.select("msg_id", (F.col("brand_with_trusted_channel") > 0).alias("trusted"), (F.col("brand_with_untrusted_channel") > 0).alias("untrusted"), (F.col("brand_lookalike_domain") > 0).alias("lookalike"))


_LABELS = ", ".join(lit(l) for l in suffixes().labels)
_COMPOUND = ", ".join(lit(c) for c in suffixes().compound)
_PARTS = "string_split(h, '.')"
_INNER = f"{_PARTS}[1:greatest(len({_PARTS}) - 1 - (CASE WHEN len({_PARTS}) >= 2 AND array_to_string({_PARTS}[-2:], '.') IN ({_COMPOUND}) THEN 2 ELSE 1 END), 0)]"


@register(f"{WITH_HOSTS} SELECT msg_id, len(list_filter(hosts, lambda h: NOT {OFFICIAL} AND len(list_filter({_INNER}, lambda l: l IN ({_LABELS}))) > 0)) > 0 AS deceptive FROM h")
def deceptive_hosts(spark, sf_dir):
    return with_hosts(spark, sf_dir).select("msg_id", F.exists("hosts", lambda h: ~official(h) & deceptive(h, suffixes())).alias("deceptive"))


@register(
    f"SELECT msg_id, ({words('text', L.DEVICE_CHANGE)} OR {hit('text', L.DEVICE_NEAR)}) AND {words('text', L.PASSIVE_CONSENT)} AND NOT {words('text', L.STOP_CUES)} AS passive, "
    f"{words('text', L.CALL_PRIMING)} AND {words('text', L.APPROVAL)} AS inbound_call, "
    f"({words('text', L.SCREEN_PROMPT)} OR {hit('text', L.QUOTED_APPEARS)}) AND ({words('text', L.SCREEN_MISMATCH)} OR {hit('text', L.MISMATCH_MODAL)} OR {hit('text', L.EXPLAIN_AWAY)}) AS mismatch, "
    f"{hit('text', L.USSD)} AND ({words('text', L.AMPLIFICATION)} OR ({hit('text', L.RECEIVE_BACK)} AND {hit('text', L.SEND_VERB)})) AS ussd_offer FROM ({M})"
)
def signals_structural(spark, sf_dir):
    low = F.lower("text")
    return messages(spark, sf_dir).select("msg_id", S.passive_device_change(low).alias("passive"), S.call_authorisation(low).alias("inbound_call"), S.screen_mismatch(low).alias("mismatch"), S.ussd_offer(F.col("text"), low).alias("ussd_offer"))


@register(
    f"WITH m AS ({M}), c AS (SELECT msg_id, text, regexp_extract_all(regexp_replace(text, {lit('(?i)' + L.STRIP_URL)}, ' ', 'g'), {lit('(?i)' + L.REFERENCE_WORDS + '([A-Z0-9][A-Z0-9./-]{5,}[^' + chr(92) + 's]*)')}, 1) AS c FROM m) "
    f"SELECT msg_id, {hit('text', L.USSD_MSISDN)} AS embeds_msisdn, len(list_filter(c, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS reference FROM c"
)
def signals_ussd_ref(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", F.col("text").rlike(L.USSD_MSISDN).alias("embeds_msisdn"), S.transaction_reference(F.col("text")).alias("reference"))


def _folded(col: str) -> str:
    out = f"translate(regexp_replace({col}, {lit('[\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x{00AD}\\x{180E}]')}, '', 'g'), {lit(C.CONFUSABLE_FROM)}, {lit(C.CONFUSABLE_TO)})"
    for pattern, to in C.DEFANGED:
        out = f"regexp_replace({out}, {lit(pattern)}, {lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return out


@register(f"SELECT msg_id, {_folded('text')} AS folded FROM ({M})")
def canonical_fold(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", C.fold(F.col("text")).alias("folded"))


_PLAIN = f"translate(t, {lit(C.LEET_FROM)}, {lit(C.LEET_TO)})"


def _deleeted(col: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({col}, '[A-Za-z0-9@$]+|[^A-Za-z0-9@$]+'), lambda t: CASE WHEN len(t) >= 3 AND regexp_matches(t, '^[A-Za-z0-9@$]*[0-9@$][A-Za-z0-9@$]*$') AND lower({_PLAIN}) IN ({', '.join(map(lit, C.LEET_WORDS))}) THEN {_PLAIN} ELSE t END), '')"


@register(f"SELECT msg_id, {_deleeted('text')} AS plain FROM ({M})")
def canonical_deleet(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", C.deleet(F.col("text")).alias("plain"))


def _unspaced(col: str) -> str:
    # a word, a run of three or more single letters, or any one character
    return f"array_to_string(list_transform(regexp_extract_all({col}, '[A-Za-z]{{2,}}|[A-Za-z](?:[ \\t][A-Za-z]\\b){{2,}}|(?s:.)'), lambda p: CASE WHEN regexp_matches(p, '^[A-Za-z][ \\t][A-Za-z]') THEN regexp_replace(p, '[ \\t]', '', 'g') ELSE p END), '')"


# no message changes under compatibility composition, which this SQL lacks; a test holds that step against Python's
CANON = f"SELECT msg_id, {_unspaced('plain')} AS text, is_fraud, o_custkey FROM (SELECT *, {_deleeted('folded')} AS plain FROM (SELECT *, {_folded('text')} AS folded FROM ({M})))"


@register(f"SELECT msg_id, text AS canon FROM ({CANON})")
def canonical_full(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", C.canonical(F.col("text")).alias("canon"))


def _numbers(col: str) -> str:
    return f"regexp_replace({col}, {lit(f'(^|[^0-9]){DIGITS}([^0-9]|$)')}, '\\1 NUM_TOKEN \\2', 'g')"


_N = f"regexp_replace(regexp_replace(text, {lit('(?i)https?://[^ ]+|www[.][^ ]+')}, ' URL_TOKEN ', 'g'), {lit('(^|[^A-Za-z0-9_.@-])(?:' + LABEL + '[.])+(?:' + _ENDS + ')' + chr(92) + 'b(?:/[^ ]*)?')}, '\\1 URL_TOKEN ', 'g')"
for _p, _to in ((L.TRACKING_ID, "TRACKING_ID_TOKEN"), ("(?i)" + L.CURRENCY_AMOUNT, "CURRENCY_AMOUNT_TOKEN"), ("(?i)" + L.CLOCK, "TIME_TOKEN"), ("[0-9]{9,}", "PHONE_TOKEN")):
    _N = f"regexp_replace({_N}, {lit(_p)}, ' {_to} ', 'g')"


@register(f"SELECT msg_id, lower({_numbers(_numbers(_N))}) AS normal FROM ({M})")
def tfidf_placeholders(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", S.normal_for_tfidf(F.col("text"), suffixes()).alias("normal"))


_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]{2,}')"


@register(f"WITH d AS (SELECT {_W} AS w FROM documents) SELECT gram, count(*) AS n FROM (SELECT unnest(w) AS gram FROM d UNION ALL SELECT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) GROUP BY gram")
def word_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(vectorize.word_ngrams(F.lower("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@register(
    "WITH w AS (SELECT ' ' || w || ' ' AS p FROM (SELECT unnest(regexp_extract_all(lower(text), '[^\\s]+')) AS w FROM benchmark)), s AS (SELECT p, unnest([3, 4, 5]) AS n FROM w) "
    "SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(p) - n + 1, 1) + 1), lambda i: substr(p, i, n))) AS gram FROM s WHERE n <= len(p) OR n = 3) GROUP BY gram"
)
def char_ngrams(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(vectorize.char_ngrams(F.lower("text"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@register(f"WITH d AS (SELECT unnest(list_distinct({_W})) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT token, count(*) AS df, round(ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1.0, 6) AS idf FROM d, n GROUP BY token")
def doc_frequency_idf(spark, sf_dir):
    return vectorize.document_frequency(table(spark, sf_dir, "documents"), vectorize.words(F.lower("text"))).withColumn("idf", F.round("idf", 6))


_POS = "conv_id * 1000 + turn"


@register(f"SELECT text, min({_POS}) AS pos FROM conversations GROUP BY text")
def dedupe_first(spark, sf_dir):
    return importer.first_of_each(table(spark, sf_dir, "conversations").select("text", F.expr(_POS).alias("pos")), "text", "pos")


@register("SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL)")
def import_antijoin(spark, sf_dir):
    return importer.new_rows(table(spark, sf_dir, "conversations").filter("text is not null").select("text").distinct(), table(spark, sf_dir, "documents"), "text")


_KINDS = list(L.SOURCE_TYPES)
_KIND = "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " ELSE 'unlisted' END"
_MAP = "CASE k " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SOURCE_TYPES.items()) + " END"


@register(f"SELECT label, count(*) AS n FROM (SELECT {_MAP} AS label FROM (SELECT {_KIND} AS k FROM orders)) GROUP BY label")
def label_mapping(spark, sf_dir):
    return importer.label_counts(importer.with_label(table(spark, sf_dir, "orders").select(F.expr(_KIND).alias("k")), "k"))


@register(f"SELECT DISTINCT k FROM (SELECT {_KIND} AS k FROM orders) WHERE k NOT IN ({', '.join(map(lit, _KINDS))})")
def unmapped_types(spark, sf_dir):
    return importer.unmapped(table(spark, sf_dir, "orders").select(F.expr(_KIND).alias("k")), "k")


_RISK = "((doc_id * 7919 + 13 * toxic) % 1000) / 1000.0"
_LAB = f"SELECT doc_id, toxic, quality, CAST({_RISK} AS DOUBLE) AS risk FROM labels"


def labelled(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "toxic", "quality", f"CAST({_RISK} AS DOUBLE) AS risk")


def _ratios(src: str, keys: str = "") -> str:
    pre = "tp / nullif(tp + fp, 0)::DOUBLE"
    rec = "tp / nullif(tp + fn, 0)::DOUBLE"
    return (
        f"SELECT {keys} tp, fn, fp, tn, round(coalesce({pre}, 0), 6) AS precision, round(coalesce({rec}, 0), 6) AS recall, round((tp + tn) / (tp + fn + fp + tn)::DOUBLE, 6) AS accuracy, "
        f"round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM ({src})"
    )


def _counts(threshold: str) -> str:
    return ", ".join(f"count(*) FILTER ({a} AND {b}) AS {n}" for n, a, b in (("tp", "toxic = 1", f"risk >= {threshold}"), ("fn", "toxic = 1", f"risk < {threshold}"), ("fp", "toxic = 0", f"risk >= {threshold}"), ("tn", "toxic = 0", f"risk < {threshold}")))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "f1") if c in df.columns})


@register(_ratios(f"SELECT {_counts('0.5')} FROM ({_LAB})"))
def confusion(spark, sf_dir):
    return _rounded(evaluate.confusion(labelled(spark, sf_dir), F.col("toxic") == 1, F.col("risk") >= 0.5))


@register(_ratios(f"SELECT threshold, {_counts('threshold')} FROM ({_LAB}), (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) GROUP BY threshold", "threshold,"))
def threshold_sweep(spark, sf_dir):
    return _rounded(evaluate.threshold_sweep(labelled(spark, sf_dir), F.col("toxic") == 1, F.col("risk")))


_PAIRS = f"SELECT CAST(toxic AS VARCHAR) AS t, CASE WHEN risk >= 0.5 THEN '1' ELSE '0' END AS p FROM ({_LAB})"


@register(
    f"WITH x AS ({_PAIRS}), c AS (SELECT DISTINCT label FROM (SELECT t AS label FROM x UNION ALL SELECT p FROM x)), "
    "n AS (SELECT label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (t = label) AS support, count(*) FILTER (p = label) AS named FROM c, x GROUP BY label), "
    "r AS (SELECT label, support, tp, coalesce(tp / nullif(named, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * tp / nullif(named + support, 0)::DOUBLE, 0) AS f1 FROM n), "
    "u AS (SELECT label, precision, recall, f1, support FROM r UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM r "
    "UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM r) "
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM u"
)
def classification_report(spark, sf_dir):
    df = labelled(spark, sf_dir).select(F.col("toxic").cast("string").alias("t"), F.when(F.col("risk") >= 0.5, "1").otherwise("0").alias("p"))
    return _rounded(evaluate.classification_report(df, "t", "p"))


@register(f"SELECT toxic, min(risk) AS min_risk, list_sort(list(risk))[count(*) // 2 + 1] AS med_risk, max(risk) AS max_risk FROM ({_LAB}) GROUP BY toxic")
def risk_spread(spark, sf_dir):
    return evaluate.risk_spread(labelled(spark, sf_dir), "toxic", "risk")


_RULES = {
    "has_full_number": FULL, "has_currency_amount": hit("text", L.CURRENCY), "authorization_via_inbound_call": f"{words('text', L.CALL_PRIMING)} AND {words('text', L.APPROVAL)}",
    "ussd_embeds_msisdn": hit("text", L.USSD_MSISDN), "requests_personal_id": asked(L.PERSONAL_ID, True), "has_shortcode": SHORT,
}


def _fired(spark, sf_dir, df=None):
    df = messages(spark, sf_dir) if df is None else df
    return evaluate.firing(S.with_signals(df, suffixes(), is_canonical=True), list(_RULES), F.col("is_fraud"))


def _firing_sql(src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS signal, count(*) FILTER (is_fraud AND {c}) AS on_positive, count(*) FILTER (NOT is_fraud AND {c}) AS on_negative FROM ({src})" for s, c in _RULES.items())


@register(_firing_sql(M))
def signal_firing_pivot(spark, sf_dir):
    return _fired(spark, sf_dir)


@register(f"SELECT signal FROM ({_firing_sql(f'SELECT * FROM ({M}) WHERE msg_id % 24 IN (2, 10, 17)')}) WHERE on_positive = 0 AND on_negative = 0")
def never_fired(spark, sf_dir):
    """Signals that never fire on three kinds of messages."""
    return evaluate.never_fired(_fired(spark, sf_dir, messages(spark, sf_dir).filter("msg_id % 24 in (2, 10, 17)")))


@register(f"SELECT signal, on_positive, row_number() OVER (ORDER BY on_positive DESC, signal) AS place FROM ({_firing_sql(M)})")
def firing_by_count(spark, sf_dir):
    ranked = evaluate.by_count(_fired(spark, sf_dir))
    return ranked.select("signal", "on_positive", F.col("place").cast("long").alias("place"))


_WEIGHT = "(CAST(l_partkey % 7 AS DOUBLE) - 3.0) / 4.0"


@register(f"SELECT key, token, contribution, CAST(rank AS BIGINT) AS rank FROM (SELECT l_orderkey AS key, CAST(l_linenumber AS VARCHAR) AS token, l_quantity * {_WEIGHT} AS contribution, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_quantity * {_WEIGHT}) DESC, CAST(l_linenumber AS VARCHAR), l_quantity * {_WEIGHT}) AS rank FROM lineitem) WHERE rank <= 5 AND contribution <> 0")
def top_contributions(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS key", "CAST(l_linenumber AS STRING) AS token", f"l_quantity * {_WEIGHT} AS contribution")
    return score.top_tokens(c, "key").withColumn("rank", F.col("rank").cast("long"))


@register(
    f"SELECT doc_id, CASE WHEN risk >= 0.8 THEN 'High-confidence fraud' WHEN risk >= 0.5 THEN 'Likely fraud' WHEN risk <= 0.4 THEN 'Likely legitimate' ELSE 'Inconclusive' END AS verdict, "
    f"NOT (risk > 0.4 AND risk < 0.5) AND abs(risk - 0.5) < 0.3 AS split_category, risk > 0.4 AND risk < 0.7 AS review FROM ({_LAB})"
)
def risk_bands(spark, sf_dir):
    confidence = F.when(F.abs(F.col("risk") - 0.5) < 0.3, 0.5).otherwise(0.9)
    return labelled(spark, sf_dir).select("doc_id", score.verdict(F.col("risk")).alias("verdict"), score.split_category(F.col("risk"), confidence).alias("split_category"), score.needs_review(F.col("risk"), True).alias("review"))


@register(f"SELECT count(*) AS n_rows, count(*) FILTER (risk >= 0.5) AS n_flagged FROM ({_LAB})")
def batch_summary(spark, sf_dir):
    return score.batch_summary(labelled(spark, sf_dir))


_KIND_OF = "CASE WHEN toxic = 1 THEN CASE WHEN risk < 0.5 THEN 'missed' ELSE 'caught' END ELSE CASE WHEN risk >= 0.5 THEN 'false_alarm' ELSE 'cleared' END END"


@register(f"SELECT doc_id, risk, {_KIND_OF} AS kind FROM ({_LAB})")
def case_listings(spark, sf_dir):
    out = [evaluate.listing(labelled(spark, sf_dir), F.col("toxic") == 1, "risk", 0.5, k).select("doc_id", "risk", F.lit(k).alias("kind")) for k in ("missed", "caught", "false_alarm", "cleared")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


_AT = "(('0x' || substr(md5(coalesce(source, 'row_' || doc_id) || '#42'), 1, 8))::BIGINT / 4294967296.0)"


@register(f"SELECT doc_id, CASE WHEN {_AT} < 0.7 THEN 'train' WHEN {_AT} < 0.8 THEN 'val' ELSE 'test' END AS part FROM documents")
def group_split(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.concat(F.lit("row_"), F.col("doc_id"))).alias("grp"))
    return importer.group_split(df, "grp", {"train": 0.7, "val": 0.1, "test": 0.2}).select("doc_id", "part")


@register("SELECT item_id, substr(sha1(text), 1, 12) AS template_id FROM benchmark")
def template_ids(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", corpus.template_id(F.col("text")).alias("template_id"))


@register(f"SELECT msg_id, translate(text, {lit(evasion.LEET[0])}, {lit(evasion.LEET[1])}) AS leet, translate(text, {lit(evasion.HOMOGLYPHS[0])}, {lit(evasion.HOMOGLYPHS[1])}) AS homoglyph, translate(text, {lit(evasion.WIDE_FROM)}, {lit(evasion.WIDE_TO)}) AS wide FROM ({M})")
def obfuscate_translate(spark, sf_dir):
    t = F.col("text")
    return messages(spark, sf_dir).select("msg_id", F.translate(t, *evasion.LEET).alias("leet"), evasion.homoglyph(t).alias("homoglyph"), evasion.fullwidth(t).alias("wide"))


@register()
def obfuscate_all(spark, sf_dir):
    return evasion.obfuscate(messages(spark, sf_dir), "text", "msg_id").select("msg_id", "technique", "obscured")


_LOW_URGENT = f"CAST(len(regexp_extract_all(lower(text), {lit(L.any_word(L.URGENCY))})) AS DOUBLE)"
_OFF, _UNOFF = f"len(list_filter(hosts, lambda h: {OFFICIAL})) > 0", f"len(list_filter(hosts, lambda h: NOT {OFFICIAL})) > 0"
_BRAND = words("text", L.BRANDS)
_ALL = {
    "has_shortcode": SHORT, "has_full_number": FULL, "has_url": f"regexp_matches(text, {_URL})", "has_currency_amount": hit("text", L.CURRENCY), "requests_sensitive_credentials": asked(L.CREDENTIALS, True),
    "brand_with_trusted_channel": f"{_BRAND} AND ({_OFF} OR {SHORT})", "brand_with_untrusted_channel": f"{_BRAND} AND ({_UNOFF} OR {FULL})",
    "has_shortener_url": f"len(list_filter(hosts, lambda h: h IN ({', '.join(map(lit, L.SHORTENERS))}))) > 0", "has_unofficial_url": _UNOFF,
    "brand_lookalike_domain": f"len(list_filter(hosts, lambda h: NOT {OFFICIAL} AND regexp_matches(h, {lit('|'.join(L.quoted(b) for b in L.BRANDS))}))) > 0",
    "requests_identity_verification": f"({asked(L.VERIFY_VERBS, False)}) OR ({asked(L.VERIFY_NOUNS, True)})", "requests_personal_id": asked(L.PERSONAL_ID, True),
    "deceptive_subdomain": f"len(list_filter(hosts, lambda h: NOT {OFFICIAL} AND len(list_filter({_INNER}, lambda l: l IN ({_LABELS}))) > 0)) > 0",
    "passive_consent_device_change": f"({words('text', L.DEVICE_CHANGE)} OR {hit('text', L.DEVICE_NEAR)}) AND {words('text', L.PASSIVE_CONSENT)} AND NOT {words('text', L.STOP_CUES)}",
    "authorization_via_inbound_call": f"{words('text', L.CALL_PRIMING)} AND {words('text', L.APPROVAL)}",
    "screen_mismatch_coaching": f"({words('text', L.SCREEN_PROMPT)} OR {hit('text', L.QUOTED_APPEARS)}) AND ({words('text', L.SCREEN_MISMATCH)} OR {hit('text', L.MISMATCH_MODAL)} OR {hit('text', L.EXPLAIN_AWAY)})",
    "ussd_advance_fee_offer": f"{hit('text', L.USSD)} AND ({words('text', L.AMPLIFICATION)} OR ({hit('text', L.RECEIVE_BACK)} AND {hit('text', L.SEND_VERB)}))", "ussd_embeds_msisdn": hit("text", L.USSD_MSISDN),
    "has_transaction_reference": f"len(list_filter(regexp_extract_all(regexp_replace(text, {lit('(?i)' + L.STRIP_URL)}, ' ', 'g'), {lit('(?i)' + L.REFERENCE_WORDS + '([A-Z0-9][A-Z0-9./-]{5,}[^' + chr(92) + 's]*)')}, 1), lambda x: regexp_matches(x, '[0-9]'))) > 0",
}


@register(f"SELECT msg_id, {_LOW_URGENT} AS urgency_word_count, {', '.join(f'{num(c)} AS {s}' for s, c in _ALL.items())} FROM (SELECT *, {HOSTS} AS hosts FROM ({CANON}))")
def canonical_signals(spark, sf_dir):
    """All twenty signals as scoring takes them: of the canonical text."""
    return S.with_signals(messages(spark, sf_dir), suffixes()).select("msg_id", *L.SIGNALS)


@register()
def all_signals(spark, sf_dir):
    """All twenty signals of the canonicalised messages, with the suffixes found by rule."""
    return S.with_signals(messages(spark, sf_dir), Suffixes.default(spark))


@register()
def generate_corpus(spark, sf_dir):
    return corpus.generate(spark, 2000)


@register()
def train_and_score(spark, sf_dir):
    """A logistic model trained on a generated corpus, applied to all messages."""
    from msgrisk.operators.train import train_all

    s = suffixes()
    trained = train_all(corpus.generate(spark, 700), s, kinds=("logistic_regression",), max_iter=25)
    return score.classify(messages(spark, sf_dir).select("msg_id", "text"), trained, s)
