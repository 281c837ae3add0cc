"""What the text of a candidate says about its query, worked out once for all later stages.

A query names its topic and its active rules by bits; a candidate gets flags and bit sets
for each window of its text. All patterns are constants and each is compiled once; a
candidate runs only those that its query names. The stages that follow test bits and never text.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import head, let, matches, strip
from ..rules import RulePack, V2

#: Windows of a candidate's text, by the column that holds what was found there.
HEAD, PLAIN, LOWER, BOTH, RESCUE, TITLE = "s_head", "s_plain", "s_lower", "s_both", "s_rescue", "s_title"


def bit(k: int) -> Column:
    return F.lit(1 << k).cast("bigint")


def asked_bits(rules: str) -> Column:
    """Bits of the rules that a query activates."""
    return F.aggregate(rules, F.lit(0).cast("bigint"), lambda a, r: a.bitwiseOR(r["bit"]))


def _any(text: Column, asked: Column, patterns: list) -> Column:
    found = F.lit(False)
    for k, pattern in patterns:
        found = found | ((asked.bitwiseAND(bit(k)) != 0) & matches(text, pattern))
    return found


def _bits(text: Column, asked: Column, patterns: list) -> Column:
    found = F.lit(0).cast("bigint")
    for k, pattern in patterns:
        found = found.bitwiseOR(F.when((asked.bitwiseAND(bit(k)) != 0) & matches(text, pattern), bit(k)).otherwise(F.lit(0).cast("bigint")))
    return found


def with_signals(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Candidates with a struct for each window: on and off (the topic's patterns), coherent (any active topic word), rules (exclusions)."""
    title, content = F.col("title"), F.col("content")
    on = [(k, c[2]) for k, c in enumerate(pack.conditions) if c[2]]
    off = [(k, c[3]) for k, c in enumerate(pack.conditions) if c[3]]
    words = [(k, c[2]) for k, c in enumerate(pack.coherence)]
    by_title = [(k, c[2]) for k, c in enumerate((*pack.title_exclusions, *pack.title_overrides))]
    by_text = [(k, c[2]) for k, c in enumerate(pack.content_exclusions)]
    topic = F.col("topic")
    with_title = lambda n: F.concat(title, F.lit(" "), head(content, n))

    def flags(*made):
        """Flags of a window: its text is worked out once."""
        def of_text(t):
            parts = {
                "on": lambda: _any(t, topic, on), "off": lambda: _any(t, topic, off),
                "coherent": lambda: _any(t, F.col("_words"), words), "rules": lambda: _bits(t, F.col("_text_rules"), by_text)}
            return F.struct(*[parts[name]().alias(name) for name in made])
        return of_text

    hits = hits.withColumns({"_words": asked_bits("coherence"), "_text_rules": asked_bits("content_exclusions"), "_title_rules": asked_bits("title_exclusions")})
    found = {
        TITLE: let(title, lambda t: F.struct(_bits(t, F.col("_title_rules"), by_title).alias("rules"))),
        HEAD: let(with_title(1000), flags("coherent")),
        PLAIN: let(with_title(1200), flags("on", "coherent", "rules")),
        LOWER: let(F.lower(with_title(1200)), flags("on", "off")),
        BOTH: let(F.concat(F.lower(strip(title)), F.lit(" "), F.lower(content)), flags("on", "off", "coherent")),
    }
    if pack.rescue:
        found[RESCUE] = F.when(F.col("content_type") == "background", let(F.lower(with_title(2000)), flags("on", "coherent")))
    return hits.withColumns(found).drop("_words", "_text_rules", "_title_rules")
