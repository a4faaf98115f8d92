"""Policies and ledgers of repositories: JSON texts with defaults for what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a policy and of a ledger, the ledger's version, commands that are gated where a policy names none, and milliseconds of a stage that names none.
_STAGE = "array<struct<name string, run array<string>, timeoutMs long>>"
POLICY = f"struct<version: long, secretGate: struct<enabled boolean, commands array<string>, mode string>, remoteAllowlist: struct<enabled boolean, hosts array<string>>, stages: struct<pre {_STAGE}, post {_STAGE}>>"
_LISTS = {
    "gates": {"name": "string", "kind": "string", "verdict": "string", "code": "int", "subcommand": "string", "at": "string"},
    "leaks": {"rule_id": "string", "path": "string", "line": "long", "fingerprint": "string", "at": "string"},
    "vulns": {"id": "string", "package": "string", "version": "string", "severity": "string", "source": "string", "at": "string"},
}
_LIST_TYPES = {k: "array<struct<" + ", ".join(f"{n} {t}" for n, t in fields.items()) + ">>" for k, fields in _LISTS.items()}
LEDGER = "struct<version: long, updated_at: string, " + ", ".join(f"{k}: {t}" for k, t in _LIST_TYPES.items()) + ">"
LEDGER_VERSION = 1
GATED, STAGE_MILLIS = ["commit", "push"], 5_000


def _parsed(text: Column, schema: str, what: str) -> Column:
    """The JSON object in ``text``; null for a null text. What isn't one object of these types fails the job."""
    whole = text.rlike(r"(?s)^\s*\{.*\}\s*$")
    return F.when(text.isNotNull(), F.from_json(F.when(whole, text).otherwise(F.raise_error(F.concat(F.lit(f"{what} isn't a JSON object: "), F.left(text, F.lit(100))))), schema, {"mode": "FAILFAST"}))


def _stages(commands: Column) -> Column:
    """Stage commands; those without a time get STAGE_MILLIS."""
    millis = lambda c: F.coalesce(F.nullif(c["timeoutMs"], F.lit(0)), F.lit(STAGE_MILLIS)).cast("long")
    no_words = F.array().cast("array<string>")
    one = lambda c: F.struct(F.coalesce(c["name"], F.lit("")).alias("name"), F.coalesce(c["run"], no_words).alias("run"), millis(c).alias("timeoutMs"))
    return F.coalesce(F.transform(commands, one), F.array().cast(_STAGE))


def policy(text: Column) -> Column:
    """A policy's JSON text as a struct of POLICY. Null, a missing file, enforces nothing; so does each field that is left out or null. A text that isn't a policy fails the job, also an empty one."""
    p = _parsed(text, POLICY, "policy")
    off, none, words = F.lit(False), F.lit(""), F.array().cast("array<string>")
    gate, remotes, stages = p["secretGate"], p["remoteAllowlist"], p["stages"]
    return F.struct(
        F.coalesce(p["version"], F.lit(0).cast("long")).alias("version"),
        F.struct(F.coalesce(gate["enabled"], off).alias("enabled"), F.coalesce(gate["commands"], words).alias("commands"), F.coalesce(gate["mode"], none).alias("mode")).alias("secretGate"),
        F.struct(F.coalesce(remotes["enabled"], off).alias("enabled"), F.coalesce(remotes["hosts"], words).alias("hosts")).alias("remoteAllowlist"),
        F.struct(_stages(stages["pre"]).alias("pre"), _stages(stages["post"]).alias("post")).alias("stages"),
    )


def gate_applies(policy_: Column, command: Column) -> Column:
    """The policy's secret gate looks at this command; without a command there is nothing to look at."""
    gate = policy_["secretGate"]
    named = F.when(F.size(gate["commands"]) == 0, command.isin(GATED)).otherwise(F.array_contains(gate["commands"], command))
    return gate["enabled"] & F.coalesce(named, F.lit(False))


def gate_blocks(policy_: Column) -> Column:
    """A finding refuses the command; otherwise it warns."""
    return policy_["secretGate"]["mode"] != "warn"


def ledger(text: Column) -> Column:
    """A ledger's JSON text as a struct of LEDGER. Null, a missing file, is an empty ledger, and what a record leaves out is blank or 0; a text that isn't a ledger fails the job, so that it isn't written over."""
    p = _parsed(text, LEDGER, "ledger")
    version = F.when(text.isNull(), F.lit(LEDGER_VERSION)).otherwise(F.coalesce(p["version"], F.lit(0)))
    blank = lambda c, kind: F.coalesce(c, (F.lit("") if kind == "string" else F.lit(0)).cast(kind))
    filled = lambda fields: lambda r: F.struct(*(blank(r[n], t).alias(n) for n, t in fields.items()))
    lists = (F.coalesce(F.transform(p[k], filled(fields)), F.array().cast(_LIST_TYPES[k])).alias(k) for k, fields in _LISTS.items())
    return F.struct(version.cast("long").alias("version"), F.coalesce(p["updated_at"], F.lit("")).alias("updated_at"), *lists)


def load(spark: SparkSession, path: str, read: str = "policy") -> DataFrame:
    """One row with the fields of the policy (or, with "ledger", the ledger) in the file at ``path``; a file that isn't there gives the defaults."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    text = spark.read.text(path, wholetext=True) if there else spark.range(1).select(F.lit(None).cast("string").alias("value"))
    if there and text.isEmpty():
        text = spark.range(1).select(F.lit("").alias("value"))
    return text.select({"policy": policy, "ledger": ledger}[read](F.col("value")).alias("x")).select("x.*")
