"""Hash buckets of identifiers, as plain Column expressions."""

from pyspark.sql import Column, functions as F

from driftline.fields import SPLIT_UPPER_BUCKETS, SPLITS


def _word_mod_100(digest: Column, word: int) -> Column:
    """The ``word``-th 64 bits of a hex digest, modulo 100.

    ``conv`` gives the unsigned number in decimal text, so its last two digits are the remainder.
    The digest occurs once, which matters where the optimizer copies the expression into a filter.
    """
    number = F.conv(F.substring(digest, 16 * word + 1, 16), 16, 10)
    return F.substring(number, -2, 2).cast("int")


def record_bucket(record_id: Column) -> Column:
    """Bucket 0-99 of a record: the leading 64 bits of the SHA-256, modulo 100."""
    return _word_mod_100(F.sha2(record_id, 256), 0)


def dataset_bucket(dataset_id: Column) -> Column:
    """Bucket 0-99 of a survey: all 256 bits of the SHA-256, modulo 100.

    2**64 is 16 modulo 100, hence the weights 16**3, 16**2, 16 and 1 of the four words.
    """
    digest = F.sha2(dataset_id, 256)
    total = F.lit(0)
    for word in range(4):
        total = total + _word_mod_100(digest, word) * pow(16, 3 - word, 100)
    return total % 100


def split_of_bucket(bucket: Column) -> Column:
    """80 / 10 / 10 label of a bucket; null for a null bucket. All bounds are tens."""
    tens = [
        next(s for s in SPLITS if ten * 10 < SPLIT_UPPER_BUCKETS[s]) for ten in range(10)
    ]
    return F.get(F.array(*map(F.lit, tens)), F.floor(bucket / 10).cast("int"))


def order_hash(seed: int, *keys: Column) -> Column:
    """Seeded pseudo-random order of rows: SHA-256 of ``seed:key``, as hex text."""
    texts = [F.coalesce(k.cast("string"), F.lit("")) for k in keys]
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", *texts)), 256)


def order_hash_bytes(seed: int, *keys: Column) -> Column:
    """``order_hash`` as 32 bytes in place of 64 characters; it sorts alike."""
    return F.unhex(order_hash(seed, *keys))
