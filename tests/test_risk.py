"""The message-risk engine: signals with guards, canonical text, hosts, evaluation, sources, SQL twins."""

import os
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from msgrisk.functions import canonical as C
from msgrisk.functions import signals as S
from msgrisk.functions.lexicons import SIGNALS
from msgrisk.functions.urls import Suffixes, deceptive, hosts, official
from msgrisk.operators import corpus, evaluate, evasion, importer, score, vectorize
from msgrisk.plans import queries as Q
from msgrisk.sources import io

SF = "/root/testdata/sf0.001"

CASES = [
    ("text 33455 to join", "has_shortcode", 1), ("Office 365 for all", "has_shortcode", 0), ("on 2026 we meet", "has_shortcode", 0),
    ("call 0771234567", "has_full_number", 1), ("code 123456", "has_full_number", 0), ("see ecocash-help.net/unlock", "has_url", 1),
    ("mail me@company.co.zw", "has_url", 0), ("15 min early.Please", "has_url", 0), ("pay $45.00", "has_currency_amount", 1), ("send 45", "has_currency_amount", 0),
    ("act now, hurry", "urgency_word_count", 2), ("I know", "urgency_word_count", 0), ("send your PIN", "requests_sensitive_credentials", 1),
    ("never share your PIN", "requests_sensitive_credentials", 0), ("Shopping is fun, send it", "requests_sensitive_credentials", 0),
    ("We never ask. Send your otp", "requests_sensitive_credentials", 1), ("EcoCash: dial 151", "brand_with_trusted_channel", 1),
    ("EcoCash http://x-pay.top", "brand_with_untrusted_channel", 1), ("go to bit.ly/abc", "has_shortener_url", 1), ("https://www.zimra.co.zw/a", "has_unofficial_url", 0),
    ("http://ecocash-win.com", "brand_lookalike_domain", 1), ("please verify", "requests_identity_verification", 1), ("your verification is done", "requests_identity_verification", 0),
    ("provide your national id", "requests_personal_id", 1), ("http://secure.cbz.co.zw.review-me.com/x", "deceptive_subdomain", 1), ("http://uz.ac.zw", "deceptive_subdomain", 0),
    ("sim swap started, no action is needed", "passive_consent_device_change", 1), ("sim swap started, no action is needed or call us", "passive_consent_device_change", 0),
    ("our agent will call, tap approve", "authorization_via_inbound_call", 1), ("technician will call to confirm", "authorization_via_inbound_call", 0),
    ("the screen may show a sale, this is normal", "screen_mismatch_coaching", 1), ("the screen is bright", "screen_mismatch_coaching", 0),
    ("dial *151*1# and get double", "ussd_advance_fee_offer", 1), ("get 5% back, dial *151#", "ussd_advance_fee_offer", 0),
    ("dial *151*0771234567*5#", "ussd_embeds_msisdn", 1), ("Ref MP250817.1432", "has_transaction_reference", 1), ("REV-88214", "has_transaction_reference", 0),
    ("bit.ly/order-claim99", "has_transaction_reference", 0), ("c l i c k  the l​ink: h**p://pay[.]top", "has_url", 1), ("send your ｐｉｎ", "requests_sensitive_credentials", 1),
]


def test_signals_and_guards(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, text string")
    rows = {r["i"]: r for r in S.with_signals(df, Suffixes.default(spark)).collect()}
    bad = [(t, s, rows[i][s]) for i, (t, s, e) in enumerate(CASES) if rows[i][s] != e]
    assert not bad
    null = S.with_signals(spark.createDataFrame([(None,)], "text string"), Suffixes.default(spark)).first()
    assert all(null[s] is None for s in SIGNALS)


def test_canonical_steps(spark):
    cases = {
        "раssword": "password", "hxxps://a[.]com": "https://a.com", "polka dot dress": "polka.dress", "acc0unt $45.00": "account $45.00", "W I N N E R now": "WINNER now",
        "": "", "a b": "a b", "ｖｅｒｉｆｙ": "verify",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", C.canonical(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == cases
    assert unicodedata.normalize("NFKC", "ｖ") == "v"


def test_hosts(spark):
    s = Suffixes.default(spark)
    df = spark.createDataFrame([("see https://User@WWW.Pay.com:80/x and foo.com.unknown or httpbin.org",)], "t string")
    assert df.select(hosts(F.col("t"), s).alias("h")).first()["h"] == ["pay.com", "foo.com"]
    h = spark.createDataFrame([("a.ecocash.co.zw",), ("ecocash.co.zw.evil.top",)], "h string")
    assert [tuple(r) for r in h.select(official(F.col("h")), deceptive(F.col("h"), s)).collect()] == [(True, False), (False, True)]


def test_ngrams(spark):
    r = spark.createDataFrame([("ab c de",)], "t string").select(vectorize.word_ngrams(F.col("t")).alias("w"), vectorize.char_ngrams(F.col("t")).alias("c")).first()
    assert r["w"] == ["ab", "de", "ab de"]
    assert r["c"] == [" ab", "ab ", " ab ", " c ", " de", "de ", " de "]


def test_importer(spark):
    raw = spark.createDataFrame([(1, "a", "none"), (2, "a", "job_offer_scam"), (3, "b", "job_offer_scam"), (4, "c", "none")], "pos int, text string, sms_type string")
    there = spark.createDataFrame([("c",)], "text string")
    assert sorted((r["text"], r["label"]) for r in importer.import_messages(raw, there, "pos").collect()) == [("a", "legit"), ("b", "other_fraud")]
    with pytest.raises(ValueError):
        importer.import_messages(raw.union(spark.createDataFrame([(5, "d", None)], raw.schema)), there, "pos")


def test_corpus_and_evasion_do_not_depend_on_partitions(spark):
    a = corpus.generate(spark, 200, seed=3).orderBy("id").collect()
    b = corpus.generate(spark, 200, seed=3).repartition(3).orderBy("id").collect()
    assert a == b and not any("{" in r["text"] for r in a) and len({r["label"] for r in a}) == 7
    df = spark.createDataFrame([(i, "pay at https://a.com now please") for i in range(60)], "id long, text string")
    out = evasion.obfuscate(df, "text", "id").collect()
    assert {r["technique"] for r in out} == set(range(6))
    assert all("hxxps://a[.]com" in r["obscured"] for r in out if r["technique"] == 4)


def test_evaluation_on_empty_input(spark):
    empty = spark.createDataFrame([], "y int, r double")
    r = evaluate.confusion(empty, F.col("y") == 1, F.col("r") >= 0.5).first()
    assert (r["tp"], r["precision"], r["f1"]) == (0, 0.0, 0.0)


def test_risk_spread_is_exact(spark):
    import random

    r = random.Random(1)
    rows = [("a", r.random()) for _ in range(30_001)] + [("b", 0.25)] * 7000 + [("b", 0.5)] * 7000 + [("b", 0.75)] + [(None, 0.1), (None, 0.9)] + [("c", None), ("d", 0.3), ("d", None)]
    got = {x["y"]: tuple(x)[1:] for x in evaluate.risk_spread(spark.createDataFrame(rows, "y string, p double").repartition(5), "y", "p").collect()}
    want = {}
    for key in {k for k, _ in rows}:
        own = sorted(p for k, p in rows if k == key and p is not None)
        if own:
            want[key] = (own[0], own[len(own) // 2], own[-1])
    assert got == want
    assert evaluate.risk_spread(spark.createDataFrame([], "y string, p double"), "y", "p").count() == 0


def test_compatibility_composition(spark):
    texts = ["ｖｅｒｉｆｙ ①", "ﬁle ㎏", "e\u0301 plain", "ascii", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", C.compatible(F.col("t")).alias("c")).collect()}
    assert got == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


def test_list_of_suffixes(spark, tmp_path, monkeypatch):
    from msgrisk.functions import urls

    (tmp_path / "s.txt").write_text("// a comment\ncom\nco.zw\n\n")
    assert Suffixes.load(spark, str(tmp_path / "s.txt")).compound == ("co.zw",)
    monkeypatch.setattr(urls, "MAX_LINES", 2)
    with pytest.raises(ValueError):
        Suffixes.load(spark, str(tmp_path / "s.txt"))


def test_upload(spark, tmp_path):
    good = tmp_path / "m.CSV"
    good.write_text('"a, ""b""",x\n"two\nlines"\n  \nlast\n')
    assert [r["text"] for r in io.read_upload(spark, str(good)).collect()] == ['a, "b"', "two\nlines", "last"]
    with pytest.raises(io.UploadError):
        io.read_upload(spark, str(tmp_path / "m.txt"))
    bad = tmp_path / "b.csv"
    bad.write_bytes(b"\xff\xfe\n")
    with pytest.raises(io.UploadError):
        io.read_upload(spark, str(bad))


def test_append_and_delete_source(spark, tmp_path):
    path = str(tmp_path / "messages")
    io.append(spark.createDataFrame([("a", "x"), ("b", "y")], "text string, source string"), path)
    io.delete_source(spark, path, "x")
    assert [r["text"] for r in spark.read.parquet(path).collect()] == ["b"]


def test_review_never_breaks(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 0.6)], "text string, risk double")

    def ask(t):
        if t == "c":
            raise RuntimeError
        return '{"verdict": "fraud", "confidence": 0.9, "reasoning": "x"}'

    got = {r["text"]: r["llm_opinion"] for r in score.review(df, ask).collect()}
    assert got["a"]["verdict"] == "fraud" and got["b"] is None and got["c"] is None


def test_shortcode_window(spark):
    df = spark.createDataFrame([("dial" + " " * 20 + "151",), ("dial" + " " * 21 + "151",), ("to" + " " * 22 + "151",)], "t string")
    assert [r[0] for r in df.select(S.shortcode(F.col("t"))).collect()] == [True, False, True]


def test_signals_keep_columns(spark):
    df = spark.createDataFrame([("call 0771234567", "kept", 9.0)], "text string, _note string, has_url double")
    out = S.with_signals(df, Q.suffixes())
    assert sorted(out.columns) == sorted({"text", "_note", *SIGNALS}) and out.first()["_note"] == "kept" and out.first()["has_url"] == 0.0


@pytest.fixture(scope="module")
def trained(spark):
    from msgrisk.operators.train import train_all

    return train_all(corpus.generate(spark, 300), Q.suffixes(), kinds=("logistic_regression",), max_iter=15)


def test_classify_and_saved_model(spark, trained, tmp_path):
    from msgrisk.operators.train import Served

    trained.save(str(tmp_path / "model"))
    served = Served(str(tmp_path / "model"))
    again = served.current()
    assert served.current() is again and again.name == trained.name
    df = spark.createDataFrame([(1, "URGENT: verify your wallet at http://secure-wallet.top/x with your PIN", "a", 0.1), (2, None, "b", 0.2), (3, "", "c", 0.3)], "id int, text string, features string, risk double")
    one = {r["id"]: r for r in score.classify(df, trained, Q.suffixes()).collect()}
    two = {r["id"]: r for r in score.classify(df, again, Q.suffixes()).collect()}
    assert one == two and one[1]["features"] == "a"
    assert one[1]["risk"] > 0.5 and one[1]["predicted_class"] != "legit" and 0 < len(one[1]["top_tokens"]) <= 5 and len(one[1]["risk_signals"]) == len(SIGNALS)
    assert (one[2]["risk"], one[2]["predicted_class"], one[2]["top_tokens"], one[2]["verdict"]) == (None, None, None, "Unscored")
    assert one[3]["risk"] is not None
    assert score.classify_one(spark, "Reminder: school fees are due", trained, Q.suffixes())["predicted_class"] in trained.model.classes
    with pytest.raises(ValueError):
        score.classify_one(spark, " ", trained, Q.suffixes())
    upload = tmp_path / "m.csv"
    upload.write_text("Claim your prize at http://bit.ly/abc today only\nMeter 12345678: units bought\n")
    rows, summary = score.classify_batch(spark, str(upload), trained, Q.suffixes())
    assert [r["pos"] for r in rows.collect()] == [0, 1] and summary.first()["n_rows"] == 2
    assert score.meta(trained.model.classes)["max_batch_rows"] == 500


def test_suite_floor(spark, trained):
    bad = ["Pay the fee at http://claim-now.top/abc and enter your card", "Agent 4 will call you, read the code to them", "You won $900! Claim your prize at http://bit.ly/xyz", "Send your PIN and OTP to keep your wallet"]
    good = ["Your appointment in Gweru is on 3 Mar at 10am", "Meter TX123456: units bought for $20.00. Thank you.", "Salary of $400.00 paid on 2 Jul. Payslip TX555555."]
    cases = spark.createDataFrame([(str(i), "smish", "own", t) for i, t in enumerate(bad)] + [(f"g{i}", "genuine", "own", t) for i, t in enumerate(good)], "id string, label string, family string, text string")
    r = score.suite_report(cases, trained, Q.suffixes(), 0.7).first()
    assert r["recall"] >= 0.75 and r["fp"] <= 1
    with pytest.raises(ValueError):
        score.suite_report(cases, trained, Q.suffixes(), 1.01)


def test_support_vector_machines(spark):
    from msgrisk.operators import train

    rows = [(float(i % 2), [float(i % 2) + 0.01 * i, 1.0 - i % 2]) for i in range(40)]
    df = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(rows)], "id long, _y double, x array<double>").select("id", "_y", train.array_to_vector("x").alias("features")).coalesce(1).persist()
    svm = train.margins(df, ["a", "b"], 10)
    said = svm.scored(df).collect()
    assert all(r["prediction"] == "ab"[int(r["_y"])] and r["probability"] is None for r in said)
    both = train.Ensemble(train.calibrated(df, ["a", "b"], "id", folds=2, max_iter=10))
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == "ab"[int(r["_y"])] for r in both.scored(df).collect())
    df.unpersist()


def test_read_import(spark, tmp_path):
    spark.createDataFrame([("a", "none"), ("a", "none"), ("b", "tax_refund_scam")], "sms_text string, smishing_type string").coalesce(1).write.parquet(str(tmp_path / "x"))
    raw = importer.read_import(spark, str(tmp_path / "x"))
    out = importer.import_messages(raw, spark.createDataFrame([], "text string"), "pos")
    assert sorted((r["text"], r["label"]) for r in out.collect()) == [("a", "legit"), ("b", "phishing_credential")]


def test_requests_and_sinks(spark, tmp_path):
    good, rest = io.read_requests(spark.createDataFrame([('{"text": "hi"}',), ('{"text": ""}',), ("no json",), (None,)], "value string"))
    assert [r["text"] for r in good.collect()] == ["hi"] and rest.count() == 3
    io.write_metrics(spark, {"f1": 0.5}, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()["value"] == '{"f1": 0.5}'
    cases = spark.createDataFrame([("S1", "smish", "x", 'a "b", c', None)], "id string, label string, family string, text string, note string")
    io.write_corpus_csv(cases, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()["text"] == 'a "b", c'
    io.write_cases(cases, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["id"] == "S1"
    assert "| legit |" in corpus.dataset_card(spark.createDataFrame([("legit",)], "label string"))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = Q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect())))
    rel = con.sql(Q.ORACLE_SQL[name])
    want = sorted(map(str, con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from rel").fetchall()))
    assert got == want


def test_streaming_signals(spark, tmp_path):
    from msgrisk.streaming.score import flagged_counts, signal_stream

    spark.sql("select timestamp'2026-01-01 00:00:00' as ts, 'call 0771234567' as text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    q = flagged_counts(signal_stream(stream, Q.suffixes()), "has_full_number > 0").writeStream.outputMode("complete").format("memory").queryName("flagged").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("flagged").first()["flagged"] == 1


def test_messages_are_dealt_by_number(spark, monkeypatch):
    from msgrisk.plans import messages as M

    want = sorted(M.messages(spark, SF).collect())
    monkeypatch.setattr(M, "TASK_ROWS", 100)
    df = M.messages(spark, SF)
    assert df.rdd.getNumPartitions() == len(want) // 100 + 1 and sorted(df.collect()) == want


def test_terms_evaluate_their_text_once(spark):
    df = spark.createDataFrame([("ab c de",)], "t string")
    plan = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan(vectorize.word_ngrams(F.lower("t"))).count("regexp_extract_all(") == 1
    assert plan(vectorize.char_ngrams(F.lower("t"))).count("concat(") == 1


def test_featurised_rows_score_alike_dense_or_sparse(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from msgrisk.operators.train import Linear

    model = Linear(["a", "b"], np.array([[1.0, 0.0, -2.0], [0.5, 3.0, 0.0]]), np.array([0.0, 0.1]), "softmax")
    rows = [(0, Vectors.dense([0.0, 1.0, 2.0])), (1, Vectors.sparse(3, [1, 2], [1.0, 2.0])), (2, Vectors.sparse(3, [], []))]
    got = model.scored(spark.createDataFrame(rows, ["i", "features"])).orderBy("i").collect()
    assert got[0]["probability"] == got[1]["probability"] and [r["prediction"] for r in got] == ["b", "b", "b"]


def test_words_are_runs_of_word_characters(spark):
    text = "".join(f"x{chr(c)}y {chr(c)}{chr(c)} " for c in range(1, 0x3100)) + "a\U0001d7d8b \U00010400\U00010401"
    df = spark.createDataFrame([(text,)], "t string").select(vectorize.words(F.col("t")).alias("w"), F.regexp_extract_all("t", F.lit(r"(?U)\b\w\w+\b"), F.lit(0)).alias("v"))
    assert "transform(" in str(vectorize.word_ngrams(F.col("t"))) and df.filter("w = v and size(w) > 10000").count() == 1


def test_texts_that_no_step_folds_skip_the_steps(spark):
    assert not any(c.isascii() for c in C.CONFUSABLE_FROM)
    texts = ["plain 45.00", "hxxp://a", "h**p : // b", "a[.]b", "a ( . ) b", "a{.}b", "polka\tD0T\ndress", "a[:]b", "a(:)b", "a[/]b", "раss", "a​b", "dot", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    steps = F.translate(F.regexp_replace("t", C.INVISIBLE, ""), C.CONFUSABLE_FROM, C.CONFUSABLE_TO)
    for pattern, to in C.DEFANGED:
        steps = F.regexp_replace(steps, pattern, to)
    assert all(r["a"] == r["b"] for r in df.select(C.fold(F.col("t")).alias("a"), steps.alias("b")).collect())
    assert [r["f"] for r in df.select(F.col("t").rlike(C.FOLDABLE).alias("f")).collect()] == [False, *[True] * 11, False, False, None]
