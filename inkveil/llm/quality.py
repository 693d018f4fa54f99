"""Quality rules as a bitmask ledger.

Each rule is evaluated once for each document; the ledger keeps one failure bit a rule
and the measurements behind them.  A policy is a named, versioned set of rules, so that
applying another policy, or finding what each rule alone takes away, needs only bitwise
work on the ledger and never the texts again.

Words are runs other than ASCII white space.  Null and empty texts have no words, fail
the ``few_words`` rule and are not kept; repeated rows are judged alike; other columns
are ignored.  A very long text is measured whole, in memory linear in its words.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Rule names; a rule's bit is its place here, and new rules go at the end.
RULES = (
    "few_words",  # fewer than 50 words
    "repeated_words",  # over half of the words stand in repeated 3-word windows
    "symbols",  # over 0.1 symbols a word
    "dup_lines",  # over 0.4 of the lines with words repeat an earlier one
    "shouting",  # over 0.4 of the code points are upper case
    "exclaiming",  # over 0.5 exclamation marks a word
    "short_words",  # mean word under 2.5 code points
    "long_words",  # mean word over 12 code points
    "no_letters",  # under 0.5 of the words have a letter
    "digits",  # over 0.4 of the code points are digits
    "low_variety",  # over 100 words of which under 0.05 differ
    "bullets",  # over 0.9 of the lines with words start with a bullet
    "ellipses",  # over 0.5 of the lines with words end in an ellipsis
)
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules that reject."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[rule] for rule in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, RULES)

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_exclaim long, n_digits long, n_letter_words long, n_distinct_words long, n_bullet_lines long, n_ellipsis_lines long"
_NAMES = [part.split()[0] for part in MEASURES.split(", ")]
_SYMBOLS, _DIGITS = "#*$%&|<>", "0123456789"
_BULLETS = ("-", "*", "•")


def repeated(words: list) -> int:
    """Words that stand in a 3-word window found twice or more, the first one included."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for window in windows:
        (twice if window in seen else seen).add(window)
    marked = bytearray(len(words))
    for i, window in enumerate(windows):
        if window in twice:
            marked[i : i + 3] = b"\1\1\1"
    return marked.count(1)


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of a whole text, in the order of MEASURES."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at space and \x09 to \x0D
    spaces = sum(data.count(c) for c in b" \t\n\v\f\r")
    lines = [line for line in data.split(b"\n") if line.strip()]
    joined = b"".join(words)
    distinct = set(words)
    letters = {w for w in distinct if w.isalpha() or any(c.isalpha() for c in w.decode("utf-8", "replace"))}
    return (
        len(words),
        len(text) - spaces,
        len(joined) - len(joined.translate(None, _SYMBOLS.encode())),
        len(lines) - len(set(lines)),
        repeated(words),
        len(lines),
        sum(map(str.isupper, text)) if not text.isascii() else len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        data.count(b"!"),
        len(data) - len(data.translate(None, _DIGITS.encode())),
        sum(w in letters for w in words),
        len(distinct),
        sum(line.decode("utf-8", "replace").lstrip().startswith(_BULLETS) for line in lines),
        sum(line.rstrip().endswith((b"...", "…".encode())) for line in lines),
    )


def failures(m: dict[str, int], n_chars: int) -> int:
    """The failure bits of one document's measurements."""
    n, lines = m["n_words"], max(m["n_lines"], 1)
    failed = (
        n < 50,
        100 * m["n_repeat_words"] > 50 * n,
        10 * m["n_symbols"] > n,
        10 * m["n_dup_lines"] > 4 * lines,
        10 * m["n_upper"] > 4 * n_chars,
        2 * m["n_exclaim"] > n,
        10 * m["word_chars"] < 25 * n,
        m["word_chars"] > 12 * n,
        2 * m["n_letter_words"] < n,
        10 * m["n_digits"] > 4 * n_chars,
        n > 100 and 20 * m["n_distinct_words"] < n,
        m["n_lines"] > 0 and 10 * m["n_bullet_lines"] > 9 * lines,
        m["n_lines"] > 0 and 2 * m["n_ellipsis_lines"] > lines,
    )
    return sum(compress(BIT.values(), failed))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed_bits``: one row a document."""

    def step():
        def work(rows):
            out = {name: [] for name in ("failed_bits", *_NAMES)}
            for text in rows["text"]:
                values = measure(text)
                for name, value in zip(_NAMES, values, strict=True):
                    out[name].append(value)
                out["failed_bits"].append(failures(dict(zip(_NAMES, values, strict=True)), max(len(text or ""), 1)))
            return out | {"doc_id": rows["doc_id"]}

        return work

    return map_rows(docs, ["doc_id", "text"], f"doc_id long, {MEASURES}, failed_bits long", step)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy rejects, rejects alone, and what stays without it.

    The ledger is first counted by its bits; rows are never compared or gathered.  An
    empty ledger gives zeros for every rule.
    """
    mask = F.lit(policy.mask).cast("long")
    counts = rows.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    session = rows.sparkSession
    rules = session.createDataFrame([(rule, BIT[rule]) for rule in policy.rules], "rule string, bit long")
    per_rule = counts.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r"), "bits", "n")
    found = per_rule.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("rejected", "rejected_alone", "kept_without")]
    return rules.join(found, "rule", "left").select("rule", *zero)


def judge(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The contract's columns: the base measurements, base_failed, and kept by the policy.

    ``failed_bits`` is the ledger's entry, ``policy`` tells which policy and version judged.
    """
    base = ~passes(BASE)
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes(policy)).alias("kept"), "failed_bits", F.lit(f"{policy.name}/{policy.version}").alias("policy"))
