"""Photos placed on the ground by the points that they share: sparse least squares over a table of ties.

A photo has two complex unknowns, z (turn and scale) and t (place): a point p of its picture lies at z * p + t. Ties
(flight, i, j, px, py, qx, qy) say that p of photo i and q of photo j are one point. What the ties of a pair of
photos add to the normal equations is eight sums, so ties are aggregated once; the equations of all flights
are solved together by conjugate gradients, with the vectors as a table of photos and the matrix as the table
of pairs. A step is one join of the pairs with both their photos and one sum by photo; the driver sees three
numbers of it. In each group of tied photos the one with most ties keeps its own placement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.operators.quantiles import exact_quantiles
from tilth.sources.shared import materialize, release

#: A pair further off than this (and five medians) is left out; what GPS places wander, and how well it must settle a turn (fixed values).
PAIR_OUTLIER_M, GPS_NOISE_M, MAX_TURN_ERROR_DEG = 0.5, 1.0, 2.0
_PAIR = ["flight", "i", "j"]
_PARTS = ("zx", "zy", "tx", "ty")


class Complex:
    """A complex number of two columns."""

    def __init__(self, re: Column, im: Column):
        self.re, self.im = re, im

    def __mul__(self, o: Complex) -> Complex:
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __add__(self, o: Complex) -> Complex:
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o: Complex) -> Complex:
        return Complex(self.re - o.re, self.im - o.im)

    def times(self, k: Column) -> Complex:
        return Complex(self.re * k, self.im * k)

    def conj(self) -> Complex:
        return Complex(self.re, -self.im)

    def square(self) -> Column:
        return self.re * self.re + self.im * self.im

    def over(self, o: Complex) -> Complex:
        return (self * o.conj()).times(1 / o.square())


def _at(prefix: str, suffix: str = "") -> Complex:
    return Complex(F.col(f"{prefix}x{suffix}"), F.col(f"{prefix}y{suffix}"))


def groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """flight, photo, group: the least photo that pairs (flight, i, j) reach from each node (flight, photo)."""
    ends = materialize(pairs.select("flight", "i", "j").union(pairs.select("flight", F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    labels = materialize(nodes.select("flight", "photo", F.col("photo").alias("group")))
    while True:
        near = ends.join(labels.withColumnRenamed("photo", "j").hint("merge"), ["flight", "j"]).groupBy("flight", F.col("i").alias("photo")).agg(F.min("group").alias("low"))
        low = labels.join(near.hint("merge"), ["flight", "photo"], "left").select("flight", "photo", F.col("group").alias("was"), F.least("group", F.coalesce("low", "group")).alias("group"))
        jump = labels.select("flight", F.col("photo").alias("group"), F.col("group").alias("next"))
        after = materialize(low.join(jump.hint("merge"), ["flight", "group"]).select("flight", "photo", F.least("group", "next").alias("group"), "was"))
        release(labels)
        labels = after.select("flight", "photo", "group")
        if after.where("group != was").isEmpty():
            release(ends)
            return labels
        labels = materialize(labels)
        release(after)


def pair_sums(ties: DataFrame) -> DataFrame:
    """The normal equations' part of each pair of photos."""
    p, q = _at("p"), _at("q")
    both = p.conj() * q
    return ties.groupBy(*_PAIR).agg(
        F.count("*").cast("double").alias("n"), *(F.sum(c).alias(f"s{c}") for c in ("px", "py", "qx", "qy")),
        F.sum(p.square()).alias("pp"), F.sum(q.square()).alias("qq"), F.sum(both.re).alias("pqx"), F.sum(both.im).alias("pqy"),
    )


def _product(sums: DataFrame, vector: DataFrame) -> DataFrame:
    """flight, photo and the normal matrix times the vector (zx, zy, tx, ty by photo)."""
    side = lambda s: vector.select("flight", F.col("photo").alias(s), *(F.col(c).alias(f"{c}{s}") for c in _PARTS))
    rows = sums.join(side("i").hint("merge"), ["flight", "i"]).join(side("j").hint("merge"), ["flight", "j"])
    z1, t1, z2, t2, n = _at("z", "i"), _at("t", "i"), _at("z", "j"), _at("t", "j"), F.col("n")
    p, q, pq = _at("sp"), _at("sq"), _at("pq")
    apart = z1 * p + (t1 - t2).times(n) - z2 * q
    first = z1.times(F.col("pp")) + (t1 - t2) * p.conj() - z2 * pq
    second = z2.times(F.col("qq")) - (t1 - t2) * q.conj() - z1 * pq.conj()
    row = lambda photo, z, t: F.struct(F.col(photo).alias("photo"), z.re.alias("zx"), z.im.alias("zy"), t.re.alias("tx"), t.im.alias("ty"))
    none = Complex(-apart.re, -apart.im)
    each = rows.select("flight", F.explode(F.array(row("i", first, apart), row("j", second, none))).alias("g")).select("flight", "g.*")
    return each.groupBy("flight", "photo").agg(*(F.sum(c).alias(c) for c in _PARTS))


def least_squares(photos: DataFrame, ties: DataFrame, tolerance: float = 1e-10, most: int = 400) -> DataFrame:
    """photos (flight, photo, zx, zy, tx, ty, held) with z and t that meet the ties best; held photos stay.

    Conjugate gradients with the matrix's diagonal as preconditioner, until the residual is below tolerance times the
    first one or `most` steps are done.
    """
    sums = materialize(pair_sums(ties))
    ends = sums.select("flight", F.explode(F.array(F.struct(F.col("i").alias("photo"), F.col("pp").alias("w"), "n"), F.struct(F.col("j").alias("photo"), F.col("qq").alias("w"), "n"))).alias("e"))
    scale = ends.groupBy("flight", F.col("e.photo").alias("photo")).agg(F.sum("e.w").alias("dz"), F.sum("e.n").alias("dt"))
    start = photos.select("flight", "photo", *_PARTS, "held")
    found = _product(sums, start)
    free = lambda c: F.when(F.col("held"), 0.0).otherwise(c)
    by = lambda c: F.col("dz" if c[0] == "z" else "dt")
    first = start.join(scale.hint("merge"), ["flight", "photo"]).join(found.select("flight", "photo", *(F.col(c).alias(f"g{c}") for c in _PARTS)).hint("merge"), ["flight", "photo"])
    state = materialize(first.select("flight", "photo", "held", "dz", "dt", *_PARTS, *(free(-F.col(f"g{c}")).alias(f"r{c}") for c in _PARTS), *(free(-F.col(f"g{c}") / by(c)).alias(f"d{c}") for c in _PARTS)))
    dot = lambda a, b, how: F.sum(sum((how(F.col(f"{a}{c}") * F.col(f"{b}{c}"), c) for c in _PARTS), F.lit(0.0)))
    plain, scaled = (lambda x, c: x), (lambda x, c: x / by(c))
    begin = None
    for _ in range(most):
        product = _product(sums, state.select("flight", "photo", *(F.col(f"d{c}").alias(c) for c in _PARTS)))
        step = materialize(state.join(product.select("flight", "photo", *(F.col(c).alias(f"q{c}") for c in _PARTS)).hint("merge"), ["flight", "photo"]).withColumns({f"q{c}": free(F.col(f"q{c}")) for c in _PARTS}))
        dq, rr, rq, qq = step.agg(dot("d", "q", plain), dot("r", "r", scaled), dot("r", "q", scaled), dot("q", "q", scaled)).first()
        begin = rr if begin is None else begin
        if not rr or not dq or rr <= begin * tolerance**2:
            release(step)
            break
        alpha = rr / dq
        beta = max(0.0, rr - 2 * alpha * rq + alpha**2 * qq) / rr
        rest = {c: F.col(f"r{c}") - alpha * F.col(f"q{c}") for c in _PARTS}
        after = materialize(step.select("flight", "photo", "held", "dz", "dt", *((F.col(c) + alpha * F.col(f"d{c}")).alias(c) for c in _PARTS), *(rest[c].alias(f"r{c}") for c in _PARTS), *((rest[c] / by(c) + beta * F.col(f"d{c}")).alias(f"d{c}") for c in _PARTS)))
        release(step, state)
        state = after
    alone = start.join(state.select("flight", "photo").hint("merge"), ["flight", "photo"], "left_anti")
    out = materialize(state.select("flight", "photo", *_PARTS, "held").union(alone.select("flight", "photo", *_PARTS, "held")))
    release(state, sums)
    return out


def tie_errors(placed: DataFrame, ties: DataFrame) -> DataFrame:
    """flight, i, j and error: root mean square distance of a pair's points."""
    side = lambda s: placed.select("flight", F.col("photo").alias(s), *(F.col(c).alias(f"{c}{s}") for c in _PARTS))
    rows = ties.join(side("i").hint("merge"), ["flight", "i"]).join(side("j").hint("merge"), ["flight", "j"])
    apart = _at("z", "i") * _at("p") + _at("t", "i") - _at("z", "j") * _at("q") - _at("t", "j")
    return rows.groupBy(*_PAIR).agg(F.sqrt(F.avg(apart.square())).alias("error"))


def place(photos: DataFrame, ties: DataFrame, rounds: int = 3, tolerance: float = 1e-10) -> DataFrame:
    """flight, photo, group, zx, zy, tx, ty and basis of photos (flight, photo, zx, zy, east, north).

    zx, zy are the turn and scale that a photo's tags give, and east, north its GPS place. Pairs of photos that
    disagree with the rest are left out and the placing is done again. Each group is then moved, turned and sized to
    its GPS places; where these are too few or too near to settle a turn it is moved only (basis shift), turned and
    sized as the flight's largest settled group was (basis like).
    """
    middle = photos.groupBy("flight").agg(F.avg("east").alias("me"), F.avg("north").alias("mn"))
    own = materialize(photos.join(middle.hint("merge"), "flight").select("flight", "photo", "zx", "zy", (F.col("east") - F.col("me")).alias("tx"), (F.col("north") - F.col("mn")).alias("ty"), "me", "mn"))
    ties = materialize(ties.select(*_PAIR, "px", "py", "qx", "qy"))
    for turn in range(rounds):
        pairs = ties.groupBy(*_PAIR).agg(F.count("*").alias("n"))
        group = groups(own, pairs)
        degree = pairs.select("flight", F.explode(F.array("i", "j")).alias("photo"), "n").groupBy("flight", "photo").agg(F.sum("n").alias("n"))
        known = group.join(degree.hint("merge"), ["flight", "photo"], "left")
        anchor = known.groupBy("flight", "group").agg(F.min_by("photo", F.struct(-F.coalesce("n", F.lit(0)), F.col("photo"))).alias("anchor"))
        member = materialize(group.join(anchor.hint("merge"), ["flight", "group"]))
        placed = least_squares(own.join(member.hint("merge"), ["flight", "photo"]).withColumn("held", F.col("photo") == F.col("anchor")), ties, tolerance)
        errors = materialize(tie_errors(placed, ties))
        limit = exact_quantiles(errors, ["flight"], "error", [0.5]).select("flight", F.greatest(F.lit(PAIR_OUTLIER_M), 5 * F.get("q", F.lit(0))).alias("limit"))
        off = materialize(errors.join(limit.hint("merge"), "flight").where("error > limit").select(*_PAIR))
        if turn + 1 == rounds or off.isEmpty():
            break
        ties = materialize(ties.join(off.hint("merge"), _PAIR, "left_anti"))
    return _onto_gps(placed, own, member)


def _onto_gps(placed: DataFrame, own: DataFrame, member: DataFrame) -> DataFrame:
    rows = placed.select("flight", "photo", *_PARTS).join(own.select("flight", "photo", F.col("zx").alias("z0x"), F.col("zy").alias("z0y"), F.col("tx").alias("gx"), F.col("ty").alias("gy"), "me", "mn").hint("merge"), ["flight", "photo"]).join(member.select("flight", "photo", "group").hint("merge"), ["flight", "photo"])
    rows = materialize(rows)
    mean = rows.groupBy("flight", "group").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in ("tx", "ty", "gx", "gy")), F.min("photo").alias("least"))
    t, g = _at("t") - _at("mt"), _at("g") - _at("mg")
    cross = t.conj() * g
    fit = rows.join(mean.hint("merge"), ["flight", "group"]).groupBy("flight", "group", "n", "least", "mtx", "mty", "mgx", "mgy").agg(F.sum(cross.re).alias("cx"), F.sum(cross.im).alias("cy"), F.sum(t.square()).alias("tt"), F.avg(g.square()).alias("gg"))
    error = F.degrees(F.atan2(F.lit(GPS_NOISE_M), F.sqrt("gg") * F.sqrt("n")))
    settled = (F.col("n") >= 3) & (error <= MAX_TURN_ERROR_DEG) & (F.col("tt") > 0)
    fit = fit.withColumn("settled", settled).withColumns({"sx": F.when(settled, F.col("cx") / F.col("tt")).otherwise(1.0), "sy": F.when(settled, F.col("cy") / F.col("tt")).otherwise(0.0)})
    # how the largest settled group's tags were off, by its least photo
    lead = fit.where("settled").groupBy("flight").agg(F.min_by("group", F.struct(-F.col("n"), F.col("group"))).alias("group"))
    first = rows.join(lead.hint("merge"), ["flight", "group"]).join(fit.select("flight", "group", "least", "sx", "sy").hint("merge"), ["flight", "group"]).where("photo = least")
    was = (_at("z") * _at("s")).over(_at("z0"))
    correction = first.select("flight", was.re.alias("kx"), was.im.alias("ky"))
    fit = fit.join(correction.hint("merge"), "flight", "left")
    like = ~F.col("settled") & F.col("kx").isNotNull()
    pick = lambda c: F.when(like, F.col(f"k{c}")).otherwise(F.col(f"s{c}"))
    fit = fit.select("flight", "group", "mtx", "mty", "mgx", "mgy", pick("x").alias("sx"), pick("y").alias("sy"), F.when(F.col("settled"), "turn").when(like, "like").otherwise("shift").alias("basis"))
    both = rows.join(fit.hint("merge"), ["flight", "group"])
    # a group that is turned like another keeps the spread that its GPS places have
    size = F.when(F.col("basis") == "like", F.sqrt(_at("s").square())).otherwise(1.0)
    z, place_ = _at("z") * _at("s"), _at("mg") + (_at("t") - _at("mt")) * _at("s").times(1 / size)
    return both.select("flight", "photo", "group", z.re.alias("zx"), z.im.alias("zy"), (place_.re + F.col("me")).alias("tx"), (place_.im + F.col("mn")).alias("ty"), "basis")
