"""Messages projected from orders and customers by one expression that Spark and the SQL oracle share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AMOUNT = "cast(cast(o_totalprice as decimal(12,2)) as string)"
PHONE = "concat('07', lpad(cast(o_orderkey % 100000000 as string), 8, '0'))"
CODE = "cast(100000 + o_orderkey % 900000 as string)"
NAME = "c_name"

# (parts, fraud): parts are literals and the names above; one shape for each signal and for each of its guards
SHAPES: list[tuple[list[str], bool]] = [
    (["'Payment of $'", AMOUNT, "' received from '", NAME, "'. Ref TX'", CODE, "'.88 thank you'"], False),
    (["'URGENT: your EcoCash account is suspended. Send your PIN to 33455 now'"], True),
    (["'We will never ask for your PIN. Do not share your password. Call us on 151 for help'"], False),
    (["'Verify your account at http://ecocash-secure.top/'", CODE, "' today only'"], True),
    (["'EcoCash bonus at https://www.ecocash.co.zw/promo dial 151 on Jul 2026'"], False),
    (["'Claim at bit.ly/'", CODE, "' or www.prize-club.net, hurry!'"], True),
    (["'Mail payroll@company.co.zw about your leave. Meet at 09:30 am'"], False),
    (["'Sign in at https://secure.onemoney.co.zw.wallet-check.com/'", CODE], True),
    (["'A new device is being linked. No action is needed if this was you.'"], True),
    (["'A new device is being linked. No action is needed, or contact the helpdesk to stop it.'"], False),
    (["'Our agent will call you shortly. Read the code and tap approve.'"], True),
    (["'The technician will call to confirm the visit on Friday'"], False),
    (["'Approve the prompt. The screen may show a purchase, this is normal.'"], True),
    (["'Send airtime with *151*1*1# and get double back'"], True),
    (["'Get 5% back on airtime, dial *151# today'"], False),
    (["'Dial *151*2*'", PHONE, "'*500# to receive USD '", AMOUNT], True),
    (["'Please provide your national ID and id number to '", PHONE], True),
    (["'Meter 1234567890 token 4455-6677-8899 units bought for ZIG '", AMOUNT], False),
    (["'hxxps://mtn-claim[.]info/'", CODE, "' your acc0unt is bl0cked'"], True),
    (["'Υour раssword: visit wallet dot help and enter the ​P​I​N'"], True),
    (["'You are a W I N N E R of $'", AMOUNT, "'! reply with your name'"], True),
    (["'Handset replacement for line 0'", CODE, "': you may disregard this notice'"], True),
    (["'Verification code '", CODE, "' is yours alone; shopping at the spa opens 10:15'"], False),
    (["'Order AB'", CODE, "' ships 2026 in 4 boxes of 250, call 12345 or 999'"], False),
]
TASK_ROWS = 20_000  # messages a task
SUFFIXES = ["com", "net", "top", "info", "help", "org", "zw", "co.zw", "ly", "co"]


def text_sql() -> str:
    whens = " ".join(f"WHEN {i} THEN concat({', '.join(parts)})" for i, (parts, _) in enumerate(SHAPES))
    return f"CASE o_orderkey % {len(SHAPES)} {whens} END"


def truth_sql() -> str:
    bad = ", ".join(str(i) for i, (_, fraud) in enumerate(SHAPES) if fraud)
    return f"o_orderkey % {len(SHAPES)} IN ({bad})"


def messages_sql() -> str:
    return f"SELECT o_orderkey AS msg_id, {text_sql()} AS text, {truth_sql()} AS is_fraud, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    both = orders.join(customer, orders.o_custkey == customer.c_custkey)
    # a message takes little room in its file and much time, so files and sizes would leave most cores idle: rows are dealt by number
    tasks = orders.count() // TASK_ROWS + 1
    if tasks > 1:
        both = both.repartition(tasks, "o_orderkey", "o_totalprice")
    return both.selectExpr("o_orderkey AS msg_id", f"{text_sql()} AS text", f"{truth_sql()} AS is_fraud", "o_custkey")
