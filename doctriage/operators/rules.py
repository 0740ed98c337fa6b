"""Confidence gates and the ordered rule table that turns a score into a final label.

Two modes:

* ``compat`` evaluates every rule exactly as written, with the effect that mixed-case
  needles and multi-word "tokens" can never fire;
* ``fixed`` reads the same table with needles lower-cased, multi-word needles tested as
  phrases, and the gate on the top probability.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from doctriage.functions import fixed
from doctriage.functions.text import any_of, has_token, shortest_needles

MODES = ("compat", "fixed")
RESULT_TYPE = "struct<class:string,outcome:string,error:string,status_code:int>"


@dataclass(frozen=True)
class Needle:
    """A keyword, tested inside the text or against its tokens."""
    text: str
    where: str = "text"                 # text | token
    if_label: str | None = None         # the model label must also equal this


@dataclass(frozen=True)
class Rule:
    needles: tuple[Needle, ...] = ()    # empty: the confidence gate
    label: str | None = None            # None: the model's own label


@dataclass(frozen=True)
class Flow:
    rules: tuple[Rule, ...]
    threshold: float
    display: tuple[tuple[str, str], ...] = ()
    denied: tuple[str, ...] = ()
    modes: tuple[str, ...] = MODES
    model_label_always: bool = False    # compat returns the model's label unchanged


def _words(needles: list[str], label: str) -> Rule:
    return Rule(tuple(Needle(n) for n in needles), label)


GATE = Rule()
PASSBOOK = Rule((Needle(" bank ", "token", "bankPassbook"), Needle("pass book", "token"),
                 Needle("Cheque", "token")), "bankPassbook")
BANK_TOKEN = Rule((Needle("bank", "token", "bankstatement  "),), "bankstatement")

FLOWS = {
    "general": Flow(
        (GATE, _words(fixed.GAS_WORDS, "Gas Bills")),
        fixed.GENERAL_THRESHOLD, tuple(fixed.GENERAL_DISPLAY.items())),
    "utility": Flow(
        (_words(fixed.GAS_WORDS, "gasbill"), GATE,
         _words(fixed.STATEMENT_WORDS, "bankstatement"),
         _words(fixed.PHONE_WORDS, "phonebill"), PASSBOOK,
         _words(fixed.ELECTRICITY_WORDS, "electricitybill"), BANK_TOKEN),
        fixed.UTILITY_THRESHOLD),
    "identity": Flow(
        (GATE, _words(fixed.GAS_WORDS, fixed.UNCLASSIFIED),
         Rule((Needle(fixed.AADHAR_PHRASE, "text", fixed.AADHAR_PHRASE),
               Needle(fixed.AADHAR_WORD)), "aadhar"),
         Rule((Needle(fixed.PAN_PHRASE, "text", fixed.PAN_PHRASE),), "pan")),
        fixed.GENERAL_THRESHOLD, tuple(fixed.IDENTITY_DISPLAY.items()),
        tuple(fixed.IDENTITY_DENIED)),
    "embedding_general": Flow(
        (GATE, _words(fixed.GAS_WORDS, "Gas Bills")),
        fixed.GENERAL_THRESHOLD, tuple(fixed.GENERAL_DISPLAY.items()),
        model_label_always=True),
    "embedding_utility": Flow(
        (_words(fixed.GAS_WORDS, "gasbill"), GATE,
         _words(fixed.PHONE_WORDS_SHORT, "phonebill"), PASSBOOK,
         _words(fixed.ELECTRICITY_WORDS, "electricitybill"), BANK_TOKEN,
         _words(fixed.STATEMENT_WORDS_SHORT, "bankstatement")),
        fixed.UTILITY_THRESHOLD, modes=("fixed",)),
}


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as rows, for inspection."""
    rows = [(name, order, needle.text, needle.where, needle.if_label, rule.label)
            for name, flow in FLOWS.items()
            for order, rule in enumerate(flow.rules)
            for needle in (rule.needles or (Needle("", "gate"),))]
    return spark.createDataFrame(
        rows, "flow string, rule_order int, needle string, tested_on string, "
              "if_label string, label string")


# ---- confidence gates ------------------------------------------------------------

def gate_compat(probability: Column) -> Column:
    """``accept`` / ``reject`` / ``error`` from the probability of class one.

    The score is the number before the decimal point of the printed probability, so
    it is positive for 1.0 and for numbers printed in scientific notation (below
    1e-4). A one-digit mantissa prints without a point, which is an error.
    """
    p = F.get(probability, F.lit(1))
    scientific = (p > 0) & (p < 1e-4)
    exponent = F.floor(F.log10(F.when(scientific, p))).cast("int")
    digit = F.round(F.try_divide(p, F.pow(F.lit(10.0), exponent))).cast("int")
    one_digit = F.concat(digit.cast("string"), F.lit("E"), exponent.cast("string"))
    return (F.when(p.isNull() | F.isnan(p), "error")
            .when(p >= 1.0, "accept")
            .when(scientific & F.coalesce(one_digit.cast("double") == p, F.lit(False)),
                  "error")
            .when(scientific, "accept")
            .otherwise("reject"))


def gate_fixed(probability: Column, threshold: float) -> Column:
    """``accept`` when the top probability is above the threshold."""
    top = F.array_max(probability)
    return (F.when(top.isNull() | F.isnan(top), "error")
            .when(top > threshold, "accept").otherwise("reject"))


# ---- labels ----------------------------------------------------------------------

def display_label(label: Column, names: dict[str, str]) -> Column:
    """The display name of a label; labels without one stay as they are."""
    if not names:
        return label
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), label)


def deny_labels(label: Column, denied: list[str]) -> Column:
    """Labels on the deny list become unclassified."""
    return F.when(label.isin(list(denied)), fixed.UNCLASSIFIED).otherwise(label)


# ---- rules -----------------------------------------------------------------------

def _can_fire(needle: Needle) -> bool:
    """Against lower-cased text, capitals never match; a token never holds a space."""
    return needle.text == needle.text.lower() and not (
        needle.where == "token" and " " in needle.text)


def _fixed_needle(needle: Needle) -> Needle:
    text, where, label = needle.text.lower(), needle.where, needle.if_label
    if where == "token":
        text = text.strip()
        where = "text" if " " in text else "token"
    if label is not None:
        wanted = label.strip().lower()
        label = next((tag for tag in fixed.TAGS if tag.lower() == wanted), None)
    return Needle(text, where, label)


def _condition(rule: Rule, mode: str, text: Column, label: Column) -> Column | None:
    """The OR of a rule's needles, without those that cannot fire or are implied."""
    needles = list(rule.needles)
    needles = ([_fixed_needle(n) for n in needles] if mode == "fixed"
               else [n for n in needles if _can_fire(n)])
    plain = shortest_needles([n.text for n in needles
                              if n.where == "text" and n.if_label is None])
    conditions = [text.contains(n) for n in plain]
    for n in needles:
        if n.where == "text" and n.if_label is None:
            continue
        hit = text.contains(n.text) if n.where == "text" else has_token(text, n.text)
        conditions.append(hit if n.if_label is None else (label == n.if_label) & hit)
    return any_of(conditions) if conditions else None


def decide(flow_name: str, mode: str, lowered: Column, label: Column, gate: Column) -> Column:
    """The final label: an ordered chain over the lower-cased text and the gate."""
    flow = FLOWS[flow_name]
    accepted = deny_labels(label, flow.denied) if flow.denied else label
    final = F
    for rule in flow.rules:
        condition = (gate == "accept" if rule is GATE
                     else _condition(rule, mode, lowered, label))
        if condition is not None:
            final = final.when(condition, accepted if rule is GATE else F.lit(rule.label))
    return display_label(final.otherwise(fixed.UNCLASSIFIED), dict(flow.display))


def outcome(final: Column, failed: Column, invalid_type: Column | None = None) -> Column:
    """Exactly one outcome per row: ok, unclassified, invalid_type or error."""
    invalid = F.lit(False) if invalid_type is None else invalid_type
    rejected = final == fixed.UNCLASSIFIED
    kind = (F.when(invalid, "invalid_type").when(failed, "error")
            .when(rejected, "unclassified").otherwise("ok"))
    return F.struct(
        F.when(invalid, fixed.INVALID_DOCUMENT).when(~failed, final).alias("class"),
        kind.alias("outcome"),
        F.when(~invalid & failed, fixed.EXTRACTION_FAILED).alias("error"),
        F.when(invalid, 415).when(failed | rejected, 424).otherwise(200).alias("status_code"))


def apply_flow(df: DataFrame, flow_name: str, mode: str, text: str = "text",
               label: str = "model_label", probability: str = "probability",
               result: str = "result") -> DataFrame:
    """Add the decision as ``struct<class, outcome, error, status_code>``.

    Projections only. The lower-cased text, the gate and the label are columns of their
    own, so that each is computed once however many rules look at it.
    """
    flow = FLOWS[flow_name]
    if mode not in flow.modes:
        raise ValueError(f"flow {flow_name} has no {mode} mode")
    missing = F.col(text).isNull() | F.col(label).isNull()
    if mode == "compat" and flow.model_label_always:
        return df.withColumn(result, outcome(F.col(label), missing))
    gate = (gate_compat(F.col(probability)) if mode == "compat"
            else gate_fixed(F.col(probability), flow.threshold))
    decided = (df.select("*", F.lower(text).alias("_lowered"), gate.alias("_gate"))
               .select("*", decide(flow_name, mode, F.col("_lowered"), F.col(label),
                                   F.col("_gate")).alias("_final")))
    return decided.withColumn(
        result, outcome(F.col("_final"), missing | (F.col("_gate") == "error"))
    ).drop("_lowered", "_gate", "_final")
