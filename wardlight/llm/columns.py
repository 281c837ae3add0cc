"""Column helpers on whole texts, and joins of hot keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words.
BLANK = r"[\x20\x09-\x0D]+"
#: Rows of a written table that may be broadcast, at under 100 bytes each.
BROADCAST_ROWS = 20_000
#: Words of the bitmap that stands for the keys of a larger table, broadcast as rows.
SIEVE = 1 << 18


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def salted(big: DataFrame, small: DataFrame, keys: list[str], how: str, spread: Column, salts: int = 64) -> DataFrame:
    """Equi-join on keys of which one may hold much of ``big``: its rows are spread by salts, ``small`` is repeated for each."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # by the size of its files Spark would take the repeated side for small and broadcast it
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str, spread: Column) -> DataFrame:
    """Join to a written table: broadcast if its counted rows are few, else salted."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, how)
    return salted(big, small, keys, how, spread)


def sieved(big: DataFrame, small: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``big`` whose keys may be in a written table, and those whose keys are not in it, so that these need not move.

    The keys are of the same names and types in both. Their hashes are bits of a map that does not grow
    with the table: with more keys, more rows than need be are in the first part.
    """
    h = F.xxhash64(*keys)
    word, bit = F.pmod(F.shiftright(h, 6), F.lit(SIEVE)).cast("int"), h.bitwiseAND(63).cast("int")
    bits = small.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    met = (word == F.col("_word")) & (F.getbit("_bits", bit) == 1)
    return big.join(F.broadcast(bits), met, "left_semi"), big.join(F.broadcast(bits), met, "left_anti")


def without(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``big`` whose keys (null: never) are not in a written table: broadcast if its counted rows are few, else only rows that may go move."""
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), keys, "left_anti")
    some, clear = sieved(big, small, keys)
    return clear.select(*big.columns).union(some.join(small, keys, "left_anti").select(*big.columns))


def renewed(docs: DataFrame, text: Column) -> list[Column]:
    """The columns of ``docs`` out of struct ``row``, with a new text and, where it is there, its n_chars."""
    def value(name: str) -> Column:
        if name == "text":
            return text
        if name == "n_chars":
            return F.length(text).cast(docs.schema[name].dataType)
        return F.col("row")[name]

    return [value(name).alias(name) for name in docs.columns]
