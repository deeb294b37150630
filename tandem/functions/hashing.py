"""Keyed uniforms (R6): the noise of a draw is a pure function of its keys.

The reference re-seeds a generator per prompt and draws one uniform per joint
vocabulary entry, so a uniform is determined by (prompt seed, step, joint id).
Here that becomes a hash column: no generator state, no noise table, no join,
and results do not depend on partitioning, retries or executor loss.

u = first 13 hex digits of md5(concat_ws('|', keys)) / 2^52, in [0, 1).
The same text in DuckDB is produced by :func:`uniform_sql` for oracle checks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def _key(k) -> Column:
    if isinstance(k, Column):
        return k.cast("string")
    if isinstance(k, str) and not k.startswith("'"):
        return F.col(k).cast("string")
    return F.lit(str(k).strip("'"))


def uniform(*keys) -> Column:
    """Uniform in [0, 1) keyed by the given columns / literals.

    Plain strings name columns; ``"'text'"`` (quoted) or non-strings are literals.
    Keys must be integers or strings (doubles would print differently per engine).
    """
    text = F.concat_ws("|", *[_key(k) for k in keys])
    # digits are read faster as an integer than as a double, and 52 bits are exact in either
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_52)


def uniform_sql(*keys: str) -> str:
    """DuckDB SQL text of :func:`uniform` (keys given as SQL expressions)."""
    return ("(('0x'||substr(md5(concat_ws('|'," + ",".join(keys) +
            ")),1,13))::BIGINT::DOUBLE/4503599627370496.0)")


def uniform_spark_sql(*keys: str) -> str:
    """Spark SQL text of :func:`uniform`."""
    return ("(cast(conv(substring(md5(concat_ws('|'," +
            ",".join(f"cast({k} as string)" for k in keys) +
            ")),1,13),16,10) as double)/4503599627370496.0)")


def seed_in_range(lo: int, hi: int, *keys) -> Column:
    """Integer seed in [lo, hi) drawn from a keyed uniform (R3: [2^24, 2^32); R4: [1e7, 99999999))."""
    return (F.lit(lo) + F.floor(uniform(*keys) * F.lit(float(hi - lo)))).cast("bigint")


def gumbel(u: Column) -> Column:
    """Gumbel noise from a uniform, with the reference's 1e-20 guards."""
    return -F.log(-F.log(u + F.lit(1e-20)) + F.lit(1e-20))


# ---- fast keyed permutation hash for repeated draws (sub-sampling iterations) -----------
# A 31-bit row seed comes from md5 once per row; each draw mixes it with the draw number
# by multiplications modulo the Mersenne prime 2^31 - 1 and xor-shifts. All products stay
# below 2^62, so Spark (ANSI), DuckDB and numpy compute identical values.
# fixed values of this hash:
MIX_P = 2147483647
MIX_STEP = 1103515245
MIX_MULTS = (48271, 1583458089, 16807)
MIX_SHIFTS = (16, 13)


def row_seed(*keys) -> Column:
    """31-bit seed of a row (first 8 hex digits of md5 of the keys, modulo 2^31 - 1)."""
    text = F.concat_ws("|", *[_key(k) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % F.lit(MIX_P)


def mix(seed: Column, draw: Column) -> Column:
    """Draw ``draw`` of a row with 31-bit ``seed``: an integer in [0, 2^31 - 1)."""
    p = F.lit(MIX_P)
    x = (seed + ((draw + 1).cast("bigint") * F.lit(MIX_STEP)) % p) % p
    x = (x * F.lit(MIX_MULTS[0])) % p
    x = x.bitwiseXOR(F.shiftright(x, MIX_SHIFTS[0]))
    x = (x * F.lit(MIX_MULTS[1])) % p
    x = x.bitwiseXOR(F.shiftright(x, MIX_SHIFTS[1]))
    return (x * F.lit(MIX_MULTS[2])) % p


def mix_np(seed, draw):
    """numpy twin of :func:`mix` (int64 arrays, broadcastable)."""
    import numpy as np
    p = np.int64(MIX_P)
    x = np.add(seed, ((draw + 1).astype(np.int64) * np.int64(MIX_STEP)) % p)
    x %= p
    for mult, shift in zip(MIX_MULTS, MIX_SHIFTS):
        x *= np.int64(mult)
        x %= p
        x ^= x >> shift
    x *= np.int64(MIX_MULTS[2])
    x %= p
    return x


def premixed_np(seed):
    """Row seeds as :func:`mix_premixed_np` takes them: multiplied by the first factor, which needs no draw number."""
    import numpy as np
    return (np.asarray(seed, np.int64) * MIX_MULTS[0] % MIX_P).astype(np.uint32)


def mix_premixed_np(seed, draw: int, out, part: int = 1 << 16):
    """:func:`mix` of one draw for row seeds of :func:`premixed_np`, into ``out`` (uint32): 32-bit operations but for the high
    halves of products, without a division, in parts that stay in the processor's cache."""
    import numpy as np
    p, half = np.uint32(MIX_P), np.uint64(31)
    first = np.uint32((draw + 1) * MIX_STEP % MIX_P * MIX_MULTS[0] % MIX_P)
    size = min(part, len(seed))
    spare, wide = np.empty(size, np.uint32), np.empty(size, np.uint64)
    for a in range(0, len(seed), part):
        y = out[a:a + part]
        z, w = spare[:len(y)], wide[:len(y)]
        np.add(seed[a:a + part], first, out=y)
        np.subtract(y, p, out=z)
        np.minimum(y, z, out=y)                     # below p the difference wraps around
        for mult, shift in zip(MIX_MULTS[1:], MIX_SHIFTS):
            np.right_shift(y, np.uint32(shift), out=z)
            y ^= z
            np.copyto(w, y)
            w *= np.uint64(mult)
            w >>= half
            np.copyto(z, w, casting="unsafe")       # 2^31 is 1 modulo p: the halves of the product are added
            y *= np.uint32(mult)
            y &= p
            y += z
            np.subtract(y, p, out=z)
            np.minimum(y, z, out=y)
    return out


def unmix_np(mixed, draw):
    """Row seeds that :func:`mix` sends to ``mixed`` in draw ``draw`` (int64 arrays). A second seed of the same value, which
    an intermediate 2^31 - 1 can make, is not found."""
    import numpy as np
    back = [np.int64(pow(m, -1, MIX_P)) for m in MIX_MULTS]
    x = np.asarray(mixed, np.int64) * back[2] % MIX_P
    for inverse, shift in zip(back[1::-1], MIX_SHIFTS[::-1]):
        x ^= (x >> shift) ^ (x >> 2 * shift)
        x = x * inverse % MIX_P
    return (x - (np.asarray(draw, np.int64) + 1) * MIX_STEP) % MIX_P


def row_seed_py(*keys) -> int:
    """Python twin of :func:`row_seed` for literal keys."""
    import hashlib
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) % MIX_P


# ---- Poisson(1) weights of a bootstrap draw --------------------------------------------
# The quantile of the keyed uniform mix / (2^31 - 1): the number of cumulative probabilities it
# reaches. The probabilities are rounded up to integers once, so all engines compare the same integers.
POISSON_STEPS = tuple(-(-int(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) * 2 ** 52) * MIX_P // 2 ** 52)
                      for k in range(12))


def poisson_weight(seed: Column, draw: Column) -> Column:
    """Poisson(1) weight of a row with 31-bit ``seed`` in draw ``draw``."""
    h = mix(seed, draw)
    return sum((F.when(h >= F.lit(t), 1).otherwise(0) for t in POISSON_STEPS[1:]), F.when(h >= F.lit(POISSON_STEPS[0]), 1).otherwise(0))


def poisson_weight_np(seed, draw):
    """numpy twin of :func:`poisson_weight`."""
    import numpy as np
    return np.searchsorted(np.array(POISSON_STEPS), mix_np(seed, draw), side="right")


def poisson_weight_sql(seed: str, draw: str) -> str:
    """DuckDB SQL text of :func:`poisson_weight`."""
    h = mix_sql(seed, draw)
    return "(" + " + ".join(f"cast({h} >= {t} as int)" for t in POISSON_STEPS) + ")"


def row_seed_sql(*keys: str) -> str:
    return f"(('0x'||substr(md5(concat_ws('|',{','.join(keys)})),1,8))::BIGINT % {MIX_P})"


def mix_sql(seed: str, draw: str) -> str:
    p = MIX_P
    x = f"(({seed} + ((cast({draw} as bigint) + 1) * {MIX_STEP}) % {p}) % {p})"
    x = f"(({x} * {MIX_MULTS[0]}) % {p})"
    x = f"xor({x}, {x} >> {MIX_SHIFTS[0]})"
    x = f"(({x} * {MIX_MULTS[1]}) % {p})"
    x = f"xor({x}, {x} >> {MIX_SHIFTS[1]})"
    return f"(({x} * {MIX_MULTS[2]}) % {p})"
