"""Column rules that the operators share."""

from __future__ import annotations

import base64
import binascii
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Codes and labels of the ledger protocol.
OP_TYPES = [
    "CREATE_ACCOUNT", "PAYMENT", "PATH_PAYMENT_STRICT_RECEIVE", "MANAGE_SELL_OFFER", "CREATE_PASSIVE_SELL_OFFER", "SET_OPTIONS", "CHANGE_TRUST",
    "ALLOW_TRUST", "ACCOUNT_MERGE", "INFLATION", "MANAGE_DATA", "BUMP_SEQUENCE", "MANAGE_BUY_OFFER", "PATH_PAYMENT_STRICT_SEND",
    "CREATE_CLAIMABLE_BALANCE", "CLAIM_CLAIMABLE_BALANCE", "BEGIN_SPONSORING_FUTURE_RESERVES", "END_SPONSORING_FUTURE_RESERVES",
    "REVOKE_SPONSORSHIP", "CLAWBACK", "CLAWBACK_CLAIMABLE_BALANCE", "SET_TRUST_LINE_FLAGS", "LIQUIDITY_POOL_DEPOSIT", "LIQUIDITY_POOL_WITHDRAW",
    "INVOKE_HOST_FUNCTION", "EXTEND_FOOTPRINT_TTL", "RESTORE_FOOTPRINT",
]
CONTRACT_OPS = (24, 25, 26)
NATIVE, CREDIT, WRAPPER, TOKEN = 0, 1, 2, 3
CONTRACT_TOKEN, CONTRACT_OTHER, CONTRACT_NFT, CONTRACT_FUNGIBLE = 0, 1, 2, 3
NATIVE_CODE = "XLM"
AMOUNT = "decimal(38,0)"


def op_type_label(code: Column) -> Column:
    """Name of an operation type; an unknown code is UNKNOWN_<code>."""
    labels = F.array(*[F.lit(x) for x in OP_TYPES])
    return F.when(code.between(0, len(OP_TYPES) - 1), F.get(labels, code.cast("int"))).otherwise(F.concat(F.lit("UNKNOWN_"), code.cast("string")))


def surrogate_id(*columns: Column) -> Column:
    """A 64-bit id that depends on the natural key only."""
    return F.xxhash64(*columns)


def asset_id(kind: Column, code: Column, issuer_id: Column, contract_id: Column) -> Column:
    """Id in the asset registry: native, credit by code and issuer, contract tokens by their own contract id."""
    return (
        F.when(kind == NATIVE, surrogate_id(F.lit("native")))
        .when(kind == CREDIT, surrogate_id(F.concat_ws(":", code, issuer_id.cast("string"))))
        .when(kind.isin(WRAPPER, TOKEN), contract_id)
    )


def pool_leg_asset_id(wire_kind: Column, code: Column, issuer_id: Column) -> Column:
    """The same id for a pool's leg, whose wire types 1 and 2 (short and long codes) are both credit."""
    kind = F.when(wire_kind.isin(1, 2), CREDIT).otherwise(wire_kind)
    return asset_id(kind, code, issuer_id, F.lit(None).cast("bigint"))


def leg_code(kind: Column, code: Column) -> Column:
    return F.when(kind == NATIVE, F.lit(NATIVE_CODE)).otherwise(code)


def visible(df: DataFrame, ledgers: DataFrame, column: str = "ledger_sequence") -> DataFrame:
    """Rows up to the head of the committed ledgers."""
    head = ledgers.agg(F.max("sequence").alias("head_"))  # one row
    return df.join(F.broadcast(head), F.col(column) <= F.col("head_")).drop("head_")


def asset_codes(text: str | None) -> list[str]:
    """At most two codes of a search text, split once at a slash; a third stays in the second."""
    return [part.strip() for part in (text or "").strip().upper().split("/", 1) if part.strip()]


def pool_filter(text: str | None, leg_a: Column, leg_b: Column) -> Column:
    """legs: leg_code(). One code: in either leg. Two: each in a leg of its own, either way. None: all."""
    codes = asset_codes(text)
    if not codes:
        return F.lit(True)
    a, b = F.upper(leg_a), F.upper(leg_b)
    if len(codes) == 1:
        return a.contains(codes[0]) | b.contains(codes[0])
    x, y = codes
    return (a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x))


def price_leg(kind: Column, code: Column, issuer: Column, contract: Column) -> Column:
    """The identity that prices are kept by, null if there can be no price."""
    return (
        F.when(kind == NATIVE, F.struct(F.lit("native").alias("kind"), F.lit("").alias("code"), F.lit("").alias("issuer")))
        .when(kind.isin(CREDIT, WRAPPER) & code.isNotNull() & (code != "") & issuer.isNotNull(), F.struct(F.lit("credit").alias("kind"), code.alias("code"), issuer.cast("string").alias("issuer")))
        .when((kind == TOKEN) & contract.isNotNull(), F.struct(F.lit("contract").alias("kind"), contract.cast("string").alias("code"), F.lit("").alias("issuer")))
    )


def fee_percent(bps: Column) -> Column:
    """Basis points as the shortest percentage text: 30 is 0.3."""
    return F.regexp_replace(F.regexp_replace((bps.cast("decimal(20,2)") / 100).cast("decimal(20,2)").cast("string"), "0+$", ""), r"\.$", "")


def usd_text(value: Column) -> Column:
    """Two decimals; a value under a cent keeps two significant digits, at most twelve decimals."""
    size = F.abs(value)
    text = F.format_string("%.2f", value)
    for places in range(4, 13):  # a value of 10^-k needs k + 1 decimals
        low, high = 10.0 ** -(places - 1), 10.0 ** -(places - 2)
        text = F.when((size > low if places < 12 else size > 0) & (size <= high) & (size < 0.01), F.format_string(f"%.{places}f", value)).otherwise(text)
    exact = F.when((size > 0.001) & (size < 0.01), F.format_string("%.4f", value))
    return F.when(value.isNull(), None).otherwise(F.coalesce(exact, text))


def decimal_text_equal(a: Column, b: Column) -> Column:
    """1, 1.0 and 1.0000000 are one amount."""

    def plain(x: Column) -> Column:
        return F.when(x.contains("."), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x)

    return plain(a).eqNullSafe(plain(b))


def classify_query(text: Column) -> Column:
    """Kind of a search text, in either case: hash, account or contract (a key or a prefix of two signs or more), else text."""
    t = F.upper(F.trim(text))
    return (
        F.when(t.rlike("^[0-9A-F]{64}$"), "hash").when(t.rlike("^G[A-Z2-7]{1,55}$"), "account").when(t.rlike("^C[A-Z2-7]{1,55}$"), "contract").otherwise("text")
    )


def key_prefix(text: str | None) -> str | None:
    """The text in upper case if it is an account's or contract's key or a prefix of one, as classify_query() has it."""
    found = (text or "").strip().upper()
    return found if re.fullmatch("[GC][A-Z2-7]{1,55}", found) else None


def asked_hash(text: str | None) -> str | None:
    """The 32 bytes that a text names, as 64 hex signs: written out, or as a pool key of 56 signs with a right checksum."""
    found = (text or "").strip()
    if re.fullmatch("[0-9a-fA-F]{64}", found):
        return found.lower()
    if re.fullmatch("L[A-Z2-7]{55}", found.upper()):
        data = base64.b32decode(found.upper())
        if data[0] == 11 << 3 and binascii.crc_hqx(data[:33], 0) == int.from_bytes(data[33:], "little"):
            return data[1:33].hex()
    return None


def classify_tx(labels: Column, count: Column) -> Column:
    """The story that the set of operation types of a transaction tells; null if unsure."""

    def only(*names: str) -> Column:
        return F.forall(labels, lambda x: x.isin(*names))

    def has(*names: str) -> Column:
        return F.exists(labels, lambda x: x.isin(*names))

    swaps = ("PATH_PAYMENT_STRICT_RECEIVE", "PATH_PAYMENT_STRICT_SEND")
    offers = ("MANAGE_SELL_OFFER", "MANAGE_BUY_OFFER", "CREATE_PASSIVE_SELL_OFFER")
    sponsors = ("BEGIN_SPONSORING_FUTURE_RESERVES", "END_SPONSORING_FUTURE_RESERVES", "REVOKE_SPONSORSHIP")
    times = F.when(count > 1, F.concat(F.lit(" · "), count.cast("string"), F.lit(" ops"))).otherwise("")
    return (
        F.when(labels.isNull() | (F.size(labels) == 0), None)
        .when(has("INVOKE_HOST_FUNCTION"), "Contract call")
        .when(only("EXTEND_FOOTPRINT_TTL", "RESTORE_FOOTPRINT"), "Contract maintenance")
        .when(has(*swaps), F.when(only(*swaps, "CHANGE_TRUST"), F.concat(F.lit("Swap"), times)))
        .when(only("PAYMENT"), F.when(count > 1, F.concat(F.lit("Payments · "), count.cast("string"))).otherwise("Payment"))
        .when(only(*offers), F.concat(F.lit("Trading"), times))
        .when(only("CHANGE_TRUST"), F.concat(F.lit("Trustline update"), times))
        .when(has("CREATE_ACCOUNT") & only("CREATE_ACCOUNT", *sponsors), F.concat(F.lit("Account creation"), times))
    )
