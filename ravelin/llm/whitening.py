"""Embedding whitening through the exact characteristic polynomial.

Entries become integers, so the scatter matrix M = n * sum(y y') - S S' (n squared times the
covariance) is an exact integer matrix; its sums are made per partition and added in Spark as
limbs.  Its characteristic polynomial is computed modulo many primes, one Spark row per prime
(reduction to Hessenberg form, then the recurrence over leading minors), and put together by
Chinese remaindering against a proven bound.

All roots are real, so the sign changes of the shifted polynomial count the roots above a point
exactly (Descartes).  One Spark row per component isolates its root by that count and bisects it
to far more digits than the distance to its neighbours needs, then takes its null space by inverse
iteration in integers.  Roots of a higher multiplicity come from the square-free factors and take
as many orthonormal vectors.

What the driver holds is the model: matrix, polynomial and vectors, whatever the number of rows.
"""

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.shared import written

#: Components at most, scale of the integers, bits of a limb and limbs of a sum.
COMPONENTS, SCALE, LIMB, LIMBS = 32, 64.0, 32, 6
#: Bits by which a root is known better than its distance from the next one.
EXTRA = 128


def sound(vector: Column) -> Column:
    """Not null, not empty, and every entry has a 64-bit integer: no null, NaN or infinity, and no
    absolute value from 2^56."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**56))
    return vector.isNotNull() & (F.size(vector) > 0) & fine


def integers(column: pa.ListArray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, integers) for each vector length in a batch."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        out.append((int(size), rows, flat[starts[rows][:, None] + np.arange(size)]))
    return out


def products(z: np.ndarray) -> np.ndarray:
    """z' z as Python integers, exact."""
    top = int(np.abs(z).max()) if z.size else 0
    if top * top * len(z) < 1 << 53:  # every partial sum is exact in doubles
        real = z.astype(np.float64)
        return (real.T @ real).astype(np.int64).astype(object)
    wide = z.astype(object)
    return wide.T @ wide


def scatter(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per vector length the exact sums of (y, 1)(y, 1)': products, sums and the count."""
    schema = "size int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, y in integers(batch.column(0)):
                z = np.concatenate([y, np.ones((len(y), 1), np.int64)], axis=1)
                sums[size] = sums.get(size, 0) + products(z)
        for size, total in sums.items():
            i, j = np.triu_indices(size + 1)
            values = [int(v) for v in total[i, j]]
            signs = [-1 if v < 0 else 1 for v in values]
            limbs = [
                pa.array([s * (abs(v) >> LIMB * k & (1 << LIMB) - 1) for s, v in zip(signs, values, strict=True)], pa.int64())
                for k in range(LIMBS)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), *limbs],
                ["size", "i", "j", *[f"l{k}" for k in range(LIMBS)]],
            )

    parts = vectors.select("v").mapInArrow(add, schema).groupBy("size", "i", "j")
    out: dict[int, np.ndarray] = {}
    for row in parts.agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).toLocalIterator():
        size = row["size"]
        total = out.setdefault(size, np.zeros((size + 1, size + 1), object))
        total[row["i"], row["j"]] = total[row["j"], row["i"]] = sum(row[f"l{k}"] << LIMB * k for k in range(LIMBS))
    return out


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bound: int) -> list[int]:
    """Primes below 2^31, falling, with a product above ``bound``."""
    out, product, n = [], 1, (1 << 31) + 1
    while product <= bound:
        n -= 2
        if is_prime(n):
            out.append(n)
            product *= n
    return out


def hessenberg(matrix: np.ndarray, p: int) -> np.ndarray:
    """A similar matrix modulo p with zeros below the first subdiagonal."""
    h = (matrix % p).astype(np.int64)
    for m in range(1, len(h) - 1):
        found = np.flatnonzero(h[m:, m - 1])
        if not len(found):
            continue
        pivot = m + int(found[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(axis=1)) % p
    return h


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, constant term first."""
    h, size = hessenberg(matrix, p), len(matrix)
    leading = np.zeros((size + 1, size + 1), np.int64)  # row k: polynomial of the first k rows
    leading[0, 0] = 1
    for k in range(1, size + 1):
        now = -int(h[k - 1, k - 1]) * leading[k - 1] % p
        now[1:] += leading[k - 1, :-1]
        chain, weights = 1, []
        for i in range(1, k):
            chain = chain * int(h[k - i, k - i - 1]) % p
            weights.append(chain * int(h[k - i - 1, k - 1]) % p)
        if weights:
            now -= (np.array(weights)[:, None] * leading[k - 2 :: -1][: k - 1] % p).sum(axis=0) % p
        leading[k] = now % p
    return leading[size]


def remaindered(residues: list[tuple[int, list[int]]]) -> list[int]:
    """Integers of least absolute value with the given residues [(prime, values)]."""
    total, product = np.zeros(len(residues[0][1]), object), 1
    for p, values in residues:
        step = (np.array([int(v) for v in values], object) - total) * pow(product, -1, p) % p
        total, product = total + product * step, product * p
    return [int(v) - product if 2 * int(v) > product else int(v) for v in total]


def bound_of(matrix: np.ndarray) -> int:
    """No coefficient of the polynomial, or of a factor of it, is larger: with roots r >= 0 they add
    up to the product of 1 + r, at most (1 + mean)^size."""
    trace = int(sum(matrix.diagonal()))
    return (1 + -(-trace // len(matrix))) ** len(matrix)


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix), constant first, for a positive semidefinite integer matrix."""
    names = primes(2 * bound_of(matrix))

    def reduce(batches):
        for batch in batches:
            found = batch.column(0).to_pylist()
            values = [polynomial_modulo(matrix, p).tolist() for p in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["p", "c"]
            )

    spread = min(len(names), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in names], "p long").repartition(spread)
    done = rows.mapInArrow(reduce, "p long, c array<long>").collect()
    return remaindered(sorted((r["p"], r["c"]) for r in done))


def gcd_modulo(f: list[int], g: list[int], p: int) -> list[int]:
    """Monic greatest common divisor modulo p, constant first."""
    a, b = (np.trim_zeros(np.array([v % p for v in x], np.int64), "b") for x in (f, g))
    while len(b):
        scale = pow(int(b[-1]), -1, p)
        while len(a) >= len(b):
            a[len(a) - len(b) :] = (a[len(a) - len(b) :] - int(a[-1]) * scale % p * b) % p
            a = np.trim_zeros(a, "b")
        a, b = b, a
    return (a * pow(int(a[-1]), -1, p) % p).tolist()


def divided(f: list[int], g: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder by a monic g."""
    rest, out = list(f), [0] * max(len(f) - len(g) + 1, 1)
    for i in range(len(f) - len(g), -1, -1):
        out[i] = rest[i + len(g) - 1]
        for j, c in enumerate(g):
            rest[i + j] -= out[i] * c
    return out, rest[: len(g) - 1]


def derivative(f: list[int]) -> list[int]:
    return [i * c for i, c in enumerate(f)][1:]


def common(f: list[int], g: list[int], bound: int) -> list[int]:
    """Greatest common divisor of f, monic with coefficients of divisors up to ``bound``, and g."""
    names = iter(primes(bound ** 2 * 8 + (1 << 310)))
    found: list[tuple[int, list[int]]] = []
    product = 1
    for p in names:
        one = gcd_modulo(f, g, p)
        if len(one) == 1:
            return [1]  # coprime modulo a prime that keeps f's degree: coprime
        if found and len(one) < len(found[0][1]):
            found, product = [], 1
        if not found or len(one) == len(found[0][1]):
            found, product = [*found, (p, one)], product * p
        if product > 2 * bound:
            divisor = remaindered(found)
            if not any(divided(f, divisor)[1]) and not any(divided(g, divisor)[1]):
                return divisor
    raise RuntimeError("no common divisor found")


def square_free(f: list[int], bound: int) -> list[tuple[int, list[int]]]:
    """[(multiplicity, factor)]: f as a product of powers of coprime square-free factors (Yun)."""
    out, power = [], 1
    shared = common(f, derivative(f), bound)
    rest, slope = divided(f, shared)[0], divided(derivative(f), shared)[0]
    while len(rest) > 1:
        change = [a - b for a, b in zip(slope, derivative(rest) + [0] * len(slope), strict=False)]
        factor = common(rest, change, bound) if any(change) else rest
        if len(factor) > 1:
            out.append((power, factor))
        rest, slope, power = divided(rest, factor)[0], divided(change, factor)[0], power + 1
    return out


def above(f: list[int], at: int, bits: int) -> int:
    """Roots of f, all of them real, above at / 2^bits: the sign changes of f shifted there."""
    degree = len(f) - 1
    c = [v << bits * (degree - i) for i, v in enumerate(f)][::-1]  # roots times 2^bits, leading first
    for stop in range(degree, 0, -1):
        for i in range(1, stop + 1):
            c[i] += at * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def sign(f: list[int], at: int, bits: int) -> int:
    """Sign of f at at / 2^bits."""
    value, scale = 0, 0
    for c in reversed(f):
        value, scale = value * at + (c << scale), scale + bits
    return (value > 0) - (value < 0)


def isolated(f: list[int], k: int) -> tuple[int, int, int]:
    """(root, distance, bits): the k-th largest root of a square-free f with real roots > 0, to the
    nearest 1 / 2^bits, and a distance within which there is no other; bits holds EXTRA more."""
    low, high, bits = 0, -f[-2], 0  # no root is above their sum
    # Bisect by counts until (low, high] holds the k-th root alone.
    n_low, n_high = len(f) - 1, 0
    while n_low - n_high != 1:
        if high - low < 2:
            low, high, bits = low << 8, high << 8, bits + 8
        middle = (low + high) // 2
        n = above(f, middle, bits)
        if n >= k:
            low, n_low = middle, n
        else:
            high, n_high = middle, n
    left, right, from_bits = low, high, bits
    side = sign(f, high, bits)
    if side == 0:  # the root is the end of its interval: move on until no other is near
        root, step = high, max(high - low, 2)
        while above(f, root + step, bits) != n_high or above(f, root - step, bits) != n_low:
            step //= 2
            if step == 0:
                root, step, bits = root << 8, 1 << 8, bits + 8
        return root << EXTRA, step << EXTRA, bits + EXTRA
    while True:
        gap = min(low - (left << bits - from_bits), (right << bits - from_bits) - high)
        if low == high:
            more = max(0, EXTRA - gap.bit_length())
            return low << more, gap << more, bits + more
        if high - low < 2:
            if gap >> EXTRA:
                return low, gap, bits
            low, high, bits = low << 64, high << 64, bits + 64
        middle = (low + high) // 2
        now = sign(f, middle, bits)
        if now == 0:
            low = high = middle
        elif now == side:
            high = middle
        else:
            low = middle


def null_space(matrix: np.ndarray, root: int, gap: int, bits: int, many: int) -> list[list[float]]:
    """``many`` orthonormal vectors that matrix - root / 2^bits maps to nearly zero, by inverse
    iteration in integers."""
    size, work = len(matrix), bits + int(max(abs(v) for v in matrix.flat)).bit_length() + 64
    a = np.array([[int(v) << bits for v in row] for row in matrix], object)
    a[np.arange(size), np.arange(size)] -= root
    u, factors, swaps = a.copy(), [], []
    for k in range(size):
        pivot = k + max(range(size - k), key=lambda i: abs(u[k + i, k]))
        swaps.append(pivot)
        if pivot != k:
            u[[k, pivot]] = u[[pivot, k]]
        if u[k, k] == 0:
            u[k, k] = 1  # singular to the last digit
        f = (u[k + 1 :, k] << work) // u[k, k]
        factors.append(f)
        if len(f):
            u[k + 1 :, k:] -= f[:, None] * u[k, k:][None, :] >> work

    def solved(b):
        b = b.copy()
        for k in range(size):
            if swaps[k] != k:
                b[[k, swaps[k]]] = b[[swaps[k], k]]
            if k + 1 < size:
                b[k + 1 :] -= factors[k] * b[k] >> work
        x = np.zeros(size, object)
        for k in range(size - 1, -1, -1):
            x[k] = ((b[k] << work) - (u[k, k + 1 :] @ x[k + 1 :] if k + 1 < size else 0)) // u[k, k]
        return scaled(x)

    def scaled(x):
        shift = work - max(int(abs(v)).bit_length() for v in x)
        return x << shift if shift >= 0 else x >> -shift

    def orthogonal(x, others):
        for y in others:
            x = x - (y * (int(x @ y) << work) // int(y @ y) >> work)
        return scaled(x)

    draw, found = 88172645463325252, []
    for _ in range(many):
        start = []
        for _ in range(size):
            draw ^= draw << 13 & (1 << 64) - 1
            draw ^= draw >> 7
            draw ^= draw << 17 & (1 << 64) - 1
            start.append((draw - (1 << 63)) << max(0, work - 64))
        x = np.array(start, object)
        for _ in range(8):
            x = solved(orthogonal(x, found) if found else x)
            x = orthogonal(x, found) if found else x
            left = max(abs(v) for v in a @ x)  # in units of 2^-bits
            if left << 60 < gap * max(abs(v) for v in x):
                break
        else:
            raise RuntimeError("inverse iteration did not settle")
        found.append(x)
    return [[int(v) / isqrt(int(x @ x)) for v in x] for x in found]


class Model:
    """Whitening of vectors of one length: integer sums, and components by falling eigenvalue."""

    def __init__(self, count, sums, trace, eigenvalues, explained, vectors):
        self.count, self.sums, self.trace = count, sums, trace
        self.eigenvalues, self.explained, self.vectors = eigenvalues, explained, vectors

    def deviations(self, y: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n y - S)^2."""
        offset = np.array([s // self.count for s in self.sums], np.int64)
        left = [int(s) % self.count for s in self.sums]
        near = y - offset
        if (self.count * (int(np.abs(near).max()) + 1)) ** 2 * y.shape[1] < 1 << 62:
            return ((self.count * near - np.array(left, np.int64)) ** 2).sum(axis=1).tolist()
        wide = self.count * near.astype(object) - np.array(left, object)
        return [int(v) for v in (wide * wide).sum(axis=1)]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        offset = np.array([s // self.count for s in self.sums], np.int64)
        part = np.array([int(s) % self.count / self.count for s in self.sums])
        centred = (y - offset).astype(np.float64) - part
        return centred @ self.vectors.T / np.sqrt(self.eigenvalues)


def fitted(spark: SparkSession, total: np.ndarray, components: int = COMPONENTS) -> Model:
    """The model of one vector length from its exact sums (``scatter``)."""
    size, count = len(total) - 1, int(total[-1, -1])
    sums = [int(v) for v in total[-1, :-1]]
    matrix = count * total[:-1, :-1] - np.outer(np.array(sums, object), np.array(sums, object))
    trace = int(sum(matrix.diagonal()))
    if trace == 0:
        return Model(count, sums, trace, np.zeros(0), np.zeros(0), np.zeros((0, size)))
    whole = characteristic(spark, matrix)
    while whole[0] == 0:  # directions without variance
        whole = whole[1:]
    factors = square_free(whole, bound_of(matrix))

    def solve(batches):
        for batch in batches:
            out = [], [], [], []
            for which, k in zip(*(batch.column(c).to_pylist() for c in ("which", "k")), strict=True):
                power, factor = factors[which]
                root, gap, bits = isolated(factor, k)
                vectors = null_space(matrix, root, gap, bits, power)
                for column, value in zip(out, (str(root), bits, power, vectors), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.list_(pa.list_(pa.float64())))],
                ["root", "bits", "power", "vectors"],
            )

    asked = [(w, k) for w, (_, f) in enumerate(factors) for k in range(1, min(components, len(f) - 1) + 1)]
    rows = spark.createDataFrame(asked, "which int, k int").repartition(len(asked), "which", "k")
    done = rows.mapInArrow(solve, "root string, bits long, power int, vectors array<array<double>>").collect()
    most = max(r["bits"] for r in done)
    done = sorted(((int(r["root"]) << most - r["bits"], r["vectors"]) for r in done), key=lambda r: -r[0])
    values, vectors = [], []
    for root, space in done:
        for vector in space[: components - len(values)]:
            values.append(root)
            vectors.append(vector)
    eigenvalues = np.array([v / (count**2 << most) for v in values])
    return Model(count, sums, trace, eigenvalues, np.array([v / (trace << most) for v in values]), np.array(vectors))


def identity_errors(whitened: DataFrame, components: int) -> dict[int, float]:
    """Per vector length the largest absolute entry of the covariance of ``w`` minus the identity,
    centred before multiplying."""
    means = whitened.groupBy("size").agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(components)])
    centre = {
        r["size"]: np.array([m for m in tuple(r)[1:] if m is not None]) for r in means.toLocalIterator()
    }

    def add(batches):
        sums: dict = {}
        for batch in batches:
            sizes = batch.column(0).to_numpy()
            for size in np.unique(sizes):
                rows = batch.column(1).filter(pa.array(sizes == size))
                w = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) - centre[size]
                sums[size] = sums.get(size, 0) + w.T @ w
            del batch
        for size, total in sums.items():
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), size), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 pa.array(total[i, j])],
                ["size", "i", "j", "s"],
            )

    parts = whitened.select("size", "w").mapInArrow(add, "size int, i int, j int, s double")
    cells = parts.groupBy("size", "i", "j").agg(F.sum("s").alias("s"))
    counts = whitened.groupBy("size").agg(F.count("*").alias("n"))
    off = F.abs(F.col("s") / F.col("n") - (F.col("i") == F.col("j")).cast("int"))
    worst = cells.join(counts, "size").groupBy("size").agg(F.max(off).alias("e"))
    return {r["size"]: r["e"] for r in worst.toLocalIterator()}


def whitened(vectors: DataFrame, key: str, vector: str, components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every row with a sound
    vector and every component that has variance, at most ``components``.

    An entry c counts as the integer floor(64 c).  Rows whose vector is null or empty or holds a
    null, a non-finite entry or one from 2^56 in size are left out.  Vectors of each length are
    fitted on their own; n counts them.  ``deviation`` (the sum of (n x - S)^2, exact) is null where
    it has over 38 digits.  Components go by falling eigenvalue; equal eigenvalues share their space
    in some orthonormal basis, the same for all rows.  Without variance (one vector, or all equal)
    there are no components and so no rows.  Null and repeated keys are rows like others; other
    columns are not read.  The model is as large as the square of the vector length.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(sound(F.col("v")))
    models = {size: fitted(spark, total, components) for size, total in scatter(rows).items()}
    models = {size: model for size, model in models.items() if len(model.eigenvalues)}

    def transform(batches):
        for batch in batches:
            shape = batch.schema.field("id").type
            for size, at, y in integers(batch.column(1)):
                model = models.get(size)
                if model is None:
                    continue
                values = model.whitened(y)
                deviations = [str(v) if v < 10**38 else None for v in model.deviations(y)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(0).take(pa.array(at)), shape), pa.array(np.full(len(at), size), pa.int32()),
                     pa.array(deviations, pa.string()),
                     pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], np.int32), values.ravel())],
                    ["id", "size", "deviation", "w"],
                )

    done = rows.mapInArrow(transform, f"id {kind}, size int, deviation string, w array<double>")
    done = written(done, "whitened")
    errors = identity_errors(done, components) if models else {}
    known = spark.createDataFrame(
        [(s, m.count, m.explained.tolist(), errors.get(s)) for s, m in models.items()],
        "size int, n long, e array<double>, identity_error double",
    )
    parts = done.join(known, "size").select(
        "id", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "identity_error", "e",
        F.posexplode("w").alias("i", "whitened"),
    )
    return parts.select(
        F.col("id").alias(key), (F.col("i") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("e", F.col("i")).alias("explained"), "identity_error",
    )
