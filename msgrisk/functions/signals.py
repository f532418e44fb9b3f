"""The twenty risk signals and the text normalisation for TF-IDF, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import lexicons as L
from msgrisk.functions.canonical import canonical
from msgrisk.functions.urls import Suffixes, deceptive, hosts, official, url_pattern


TMP = "msgrisk_tmp_"  # of column names that exist within a function only


def has(text: Column, pattern: str) -> Column:
    return text.rlike(L.ignoring_case(pattern))


def has_any(text: Column, words: list[str]) -> Column:
    return has(text, L.any_word(words))


def requested(lower: Column, words: list[str], needs_cue: bool) -> Column:
    """Some sentence names one of ``words``, negates nothing and, if needed, asks for it."""
    lex, neg, cue = L.any_word(words), L.any_word(L.NEGATION), L.any_word(L.REQUEST_CUES)

    def asks(s: Column) -> Column:
        hit = s.rlike(lex) & ~s.rlike(neg)
        return hit & s.rlike(cue) if needs_cue else hit

    return lower.rlike(lex) & F.exists(F.split(lower, L.SENTENCE_ENDS), asks)


def shortcode(text: Column) -> Column:
    """A code right after a cue word; cue and gap together take at most ``CUE_WINDOW`` characters."""
    cues = "|".join(rf"{c}\b[\s:,\-]{{0,{L.CUE_WINDOW - len(c)}}}" for c in L.CONTACT_CUES)
    return has(text, rf"\b(?:{cues})" + L.SHORTCODE)


def passive_device_change(low: Column) -> Column:
    return (has_any(low, L.DEVICE_CHANGE) | has(low, L.DEVICE_NEAR)) & has_any(low, L.PASSIVE_CONSENT) & ~has_any(low, L.STOP_CUES)


def call_authorisation(low: Column) -> Column:
    return has_any(low, L.CALL_PRIMING) & has_any(low, L.APPROVAL)


def screen_mismatch(low: Column) -> Column:
    prompt = has_any(low, L.SCREEN_PROMPT) | has(low, L.QUOTED_APPEARS)
    return prompt & (has_any(low, L.SCREEN_MISMATCH) | has(low, L.MISMATCH_MODAL) | has(low, L.EXPLAIN_AWAY))


def ussd_offer(text: Column, low: Column) -> Column:
    return text.rlike(L.USSD) & (has_any(low, L.AMPLIFICATION) | (has(low, L.RECEIVE_BACK) & has(low, L.SEND_VERB)))


def transaction_reference(text: Column) -> Column:
    return has(F.regexp_replace(text, L.ignoring_case(L.STRIP_URL), " "), L.REFERENCE)


MENTIONS = {
    "requests_sensitive_credentials": L.CREDENTIALS,
    "requests_identity_verification": [*L.VERIFY_VERBS, *L.VERIFY_NOUNS],
    "requests_personal_id": L.PERSONAL_ID,
}


def mentioned(signal: str, raw: Column) -> Column:
    return has_any(raw, MENTIONS[signal])


def with_canonical(df: DataFrame, suffixes: Suffixes, text: str = "text", is_canonical: bool = False) -> DataFrame:
    """Adds the canonical text, its lower case and its hosts under names with TMP, in projections of their own, so that twenty signals share them."""
    df = df.withColumn(f"{TMP}canon", F.col(text) if is_canonical else canonical(F.col(text)))
    return df.withColumn(f"{TMP}low", F.lower(f"{TMP}canon")).withColumn(f"{TMP}hosts", hosts(F.col(f"{TMP}canon"), suffixes))


def with_signals(df: DataFrame, suffixes: Suffixes, text: str = "text", is_canonical: bool = False, keep: bool = False) -> DataFrame:
    """Adds the twenty signals as doubles; a null text gives null signals.

    A column that bears a signal's name is replaced; all others are kept.
    """
    own = [c for c in df.columns if c not in L.SIGNALS]
    df = with_canonical(df, suffixes, text, is_canonical)
    t, low, hs = F.col(f"{TMP}canon"), F.col(f"{TMP}low"), F.col(f"{TMP}hosts")
    df = df.withColumn(f"{TMP}brand", has_any(low, L.BRANDS)).withColumn(f"{TMP}short", shortcode(t)).withColumn(f"{TMP}full", t.rlike(L.FULL_NUMBER))
    df = df.withColumn(f"{TMP}off", F.exists(hs, official)).withColumn(f"{TMP}unoff", F.filter(hs, lambda h: ~official(h)))
    un = F.col(f"{TMP}unoff")
    brands = "|".join(L.quoted(b) for b in L.BRANDS)
    columns = {
        "has_shortcode": F.col(f"{TMP}short"),
        "has_full_number": F.col(f"{TMP}full"),
        "has_url": t.rlike(url_pattern(suffixes)),
        "has_currency_amount": has(t, L.CURRENCY),
        "urgency_word_count": F.regexp_count(low, F.lit(L.any_word(L.URGENCY))),
        "requests_sensitive_credentials": requested(low, L.CREDENTIALS, True),
        "brand_with_trusted_channel": F.col(f"{TMP}brand") & (F.col(f"{TMP}off") | F.col(f"{TMP}short")),
        "brand_with_untrusted_channel": F.col(f"{TMP}brand") & ((F.size(un) > 0) | F.col(f"{TMP}full")),
        "has_shortener_url": F.exists(hs, lambda h: h.isin(L.SHORTENERS)),
        "has_unofficial_url": F.size(un) > 0,
        "brand_lookalike_domain": F.exists(un, lambda h: h.rlike(brands)),
        "requests_identity_verification": requested(low, L.VERIFY_VERBS, False) | requested(low, L.VERIFY_NOUNS, True),
        "requests_personal_id": requested(low, L.PERSONAL_ID, True),
        "deceptive_subdomain": F.exists(un, lambda h: deceptive(h, suffixes)),
        "passive_consent_device_change": passive_device_change(low),
        "authorization_via_inbound_call": call_authorisation(low),
        "screen_mismatch_coaching": screen_mismatch(low),
        "ussd_advance_fee_offer": ussd_offer(t, low),
        "ussd_embeds_msisdn": t.rlike(L.USSD_MSISDN),
        "has_transaction_reference": transaction_reference(t),
    }
    kept = own + ([f"{TMP}canon"] if keep else [])
    return df.select(*kept, *(columns[n].cast("double").alias(n) for n in L.SIGNALS))


def normal_for_tfidf(canon: Column, suffixes: Suffixes) -> Column:
    """Numeric specifics become placeholders, in this order; then lower case."""
    for pattern, to in (
        (url_pattern(suffixes), "URL_TOKEN"), (L.TRACKING_ID, "TRACKING_ID_TOKEN"), (L.ignoring_case(L.CURRENCY_AMOUNT), "CURRENCY_AMOUNT_TOKEN"),
        (L.ignoring_case(L.CLOCK), "TIME_TOKEN"), (L.FULL_NUMBER, "PHONE_TOKEN"), (L.SHORTCODE, "NUM_TOKEN"),
    ):
        canon = F.regexp_replace(canon, pattern, f" {to} ")
    return F.lower(canon)
