"""The array-expression language, compiled to Column pairs.

Infix, over images named A, B, ..., Z, AA, ... (columns of a joined pixel table) and complex scalars. Operators from
loosest: `,`  `&&` `||`  `==`  `<` `>`  `+` `-`  `*` `/`  unary `+` `-` and postfix `i`  `^`; functions abs arg re im conj exp
log sqrt min max if sum mask set_mask posx posy posz. Comparisons look at moduli and give 1 or 0; im(x) keeps the
imaginary part in its place; min and max work on each component; `^` takes a scalar exponent; a scalar 0 as divisor
gives 0. fft and ifft need whole images: see operators.fourier. define() adds functions of the user's own.

A recursive-descent parser makes a small tree; compile() turns it into one (re, im) pair, which Catalyst folds and
compiles with the rest of the plan. sum() is a window over the image, so a program is a single pass. Over packed rows
evaluate_packed() computes the same in batches of numpy, where sums and transforms need no exchange.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import angle as phase_of


class ExpressionError(ValueError):
    pass


FUNCTIONS = {"abs": 1, "arg": 1, "re": 1, "im": 1, "conj": 1, "exp": 1, "log": 1, "sqrt": 1, "min": 2, "max": 2, "if": 3, "sum": 1, "mask": 1, "set_mask": 2, "posx": 1, "posy": 1, "posz": 1, "fft": 1, "ifft": 1}
LEVELS = [["&&", "||"], ["=="], ["<", ">"], ["+", "-"], ["*", "/"]]
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?)|(?P<image>[A-Z]+)|(?P<name>set_mask|pos[xyz]|[a-z]+)|(?P<op>&&|\|\||==|[-+*/^<>(),]))")


#: Functions of the user's: name -> (number of operands, function of (re, im) pairs or name of an SQL function).
USER: dict[str, tuple[int, Callable | str]] = {}


def define(name: str, operands: int, function: Callable | str) -> None:
    """Makes a function known to expressions: of as many (re, im) pairs of Columns, giving a pair; or the name of a function of the session's SQL, which takes re and im of each operand in turn and returns a struct of re and im (a body in SQL is folded into the plan like the rest)."""
    if not re.fullmatch("[a-z]+", name) or name == "i" or name in FUNCTIONS:
        raise ExpressionError(f"{name!r} can't be the name of a function")
    if operands < 1:
        raise ExpressionError("a function takes an operand at least")
    USER[name] = operands, function


def operands_of(name: str) -> int | None:
    return FUNCTIONS.get(name) or USER.get(name, (None,))[0]


@dataclass(frozen=True)
class Node:
    kind: str
    args: tuple = ()
    value: object = None


def image_number(name: str) -> int:
    """A is 0, Z 25, AA 26."""
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n - 1


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"cannot read {text[at:]!r}")
        kind = m.lastgroup
        word = m[kind]
        if kind == "name" and not operands_of(word) and word != "i":
            raise ExpressionError(f"unknown function {word!r}")
        out.append((kind, word))
        at = m.end()
    return out


def parse(text: str) -> Node:
    tokens, at = tokenize(text), 0

    def peek():
        return tokens[at][1] if at < len(tokens) else None

    def take(expected=None):
        nonlocal at
        if at >= len(tokens) or (expected and tokens[at][1] != expected):
            raise ExpressionError(f"too few operands: {expected or 'a value'} expected" if at >= len(tokens) else f"{expected!r} expected, not {tokens[at][1]!r}")
        at += 1
        return tokens[at - 1]

    def level(k):
        if k == len(LEVELS):
            return unary()
        left = level(k + 1)
        while peek() in LEVELS[k]:
            op = take()[1]
            left = Node(op, (left, level(k + 1)))
        return left

    def unary():
        if peek() == "-":
            take()
            return Node("neg", (unary(),))
        if peek() == "+":
            take()
            return unary()
        return power()

    def power():
        base = postfix()
        if peek() == "^":
            take()
            return Node("^", (base, unary()))
        return base

    def postfix():
        x = primary()
        while peek() == "i":
            take()
            x = Node("times_i", (x,))
        return x

    def primary():
        kind, word = take()
        if kind == "number":
            return Node("number", value=float(word))
        if kind == "image":
            return Node("image", value=image_number(word))
        if word == "i":
            return Node("times_i", (Node("number", value=1.0),))
        if word == "(":
            x = level(0)
            take(")")
            return x
        if kind == "name":
            if word.startswith("pos") and peek() != "(":  # of the first image
                return Node(word, (Node("image", value=0),))
            take("(")
            args = [level(0)]
            while peek() == ",":
                take()
                args.append(level(0))
            take(")")
            if len(args) != operands_of(word):
                raise ExpressionError(f"{word} takes {operands_of(word)} operands, not {len(args)}")
            return Node(word, tuple(args))
        raise ExpressionError(f"too few operands before {word!r}")

    tree = level(0)
    if at != len(tokens):
        raise ExpressionError(f"operands are left over: {tokens[at][1]!r}")
    return tree


def is_scalar(n: Node) -> bool:
    return n.kind == "number" or n.kind == "sum" or (n.kind != "image" and all(is_scalar(a) for a in n.args))


def images_of(n: Node) -> set[int]:
    return {n.value} if n.kind == "image" else set().union(*[images_of(a) for a in n.args]) if n.args else set()


def compile_node(n: Node, image: str = "image_id") -> tuple[Column, Column, Column]:
    """re, im, mask of a tree over columns re0, im0, mask0, re1, ... and x, y, z."""
    zero, one = F.lit(0.0), F.lit(1)
    go = lambda k: compile_node(n.args[k], image)
    bit = lambda c: F.when(c, 1.0).otherwise(0.0)
    if n.kind == "number":
        return F.lit(n.value), zero, one
    if n.kind == "image":
        return F.col(f"re{n.value}"), F.col(f"im{n.value}"), F.col(f"mask{n.value}")
    if n.kind in ("fft", "ifft"):
        raise ExpressionError(f"{n.kind} is taken of whole images, by evaluate()")
    if n.kind in ("posx", "posy", "posz", "mask", "set_mask") and is_scalar(n.args[0]):
        raise ExpressionError(f"{n.kind} takes an image")
    if n.kind in USER:
        parts = [go(k) for k in range(len(n.args))]
        m = next((p[2] for p, x in zip(parts, n.args, strict=True) if not is_scalar(x)), one)
        function = USER[n.kind][1]
        if callable(function):
            a, b = function(*[(p[0], p[1]) for p in parts])
            return a, b, m
        found = F.call_function(function, *[c for p in parts for c in p[:2]])
        return found["re"], found["im"], m
    a, b, m = go(0)
    if n.kind == "neg":
        return -a, -b, m
    if n.kind == "times_i":
        return -b, a, m
    if n.kind in ("posx", "posy", "posz"):
        return F.col(n.kind[-1]).cast("double"), zero, m
    if n.kind == "mask":
        return m.cast("double"), zero, m
    if n.kind == "abs":
        return F.hypot(a, b), zero, m
    if n.kind == "arg":
        return phase_of(b, a), zero, m
    if n.kind == "re":
        return a, zero, m
    if n.kind == "im":
        return zero, b, m
    if n.kind == "conj":
        return a, -b, m
    if n.kind == "exp":
        return F.exp(a) * F.cos(b), F.exp(a) * F.sin(b), m
    size, angle = F.hypot(a, b), phase_of(b, a)
    if n.kind == "log":
        return F.when(size > 0, F.log(size)).otherwise(F.lit(float("-inf"))), angle, m
    if n.kind == "sqrt":
        return F.sqrt(size) * F.cos(angle / 2), F.sqrt(size) * F.sin(angle / 2), m
    if n.kind == "sum":
        if is_scalar(n.args[0]):
            return a, b, m
        w = Window.partitionBy(image)
        return F.sum(a).over(w), F.sum(b).over(w), m
    c, d, m2 = go(1)
    if n.kind == "set_mask":
        return a, b, F.floor(F.hypot(c, d)).cast("int")
    m = m2 if is_scalar(n.args[0]) else m
    if n.kind == "if":
        e, f, _ = go(2)
        return F.when(F.hypot(a, b) != 0, c).otherwise(e), F.when(F.hypot(a, b) != 0, d).otherwise(f), m
    if n.kind == "+":
        return a + c, b + d, m
    if n.kind == "-":
        return a - c, b - d, m
    if n.kind == "*":
        return a * c - b * d, a * d + b * c, m
    if n.kind == "/":
        q = c * c + d * d
        by = F.when(q == 0, 0.0 if is_scalar(n.args[1]) else None).otherwise(1 / F.nullif(q, zero))
        return (a * c + b * d) * by, (b * c - a * d) * by, m
    if n.kind == "^":
        if not is_scalar(n.args[1]):
            raise ExpressionError("the exponent must be a number, not an image")
        ln = F.when(size > 0, F.log(size))
        grow, turn = F.exp(c * ln - d * angle), d * ln + c * angle
        at_zero = F.when((c == 0) & (d == 0), 1.0).otherwise(0.0)
        return F.when(size > 0, grow * F.cos(turn)).otherwise(at_zero), F.when(size > 0, grow * F.sin(turn)).otherwise(0.0), m
    if n.kind in ("min", "max"):
        pick = F.least if n.kind == "min" else F.greatest
        return pick(a, c), pick(b, d), m
    if n.kind in ("<", ">"):
        return bit(size < F.hypot(c, d) if n.kind == "<" else size > F.hypot(c, d)), zero, m
    if n.kind == "==":
        return bit((a == c) & (b == d)), zero, m
    both = (size != 0, F.hypot(c, d) != 0)
    return bit(both[0] & both[1] if n.kind == "&&" else both[0] | both[1]), zero, m


def _transformed(rows: DataFrame, n: Node, number: int) -> DataFrame:
    """rows with the transform of a tree over them as variable `number`; all its pixels are measured. Each image is packed, transformed and unpacked."""
    from ..model import unpack
    from ..operators import fourier

    if is_scalar(n.args[0]):
        raise ExpressionError(f"{n.kind} takes an image")
    a, b, _ = compile_node(n.args[0])
    cells = rows.select("image_id", "i", "x", "y", "z", a.alias("re"), b.alias("im"))
    side = lambda c: (F.max(c) + 1).cast("int")
    c = F.array_sort(F.collect_list(F.struct("i", "re", "im"))).alias("c")
    packed = cells.groupBy("image_id").agg(c, side("x").alias("nx"), side("y").alias("ny"), side("z").alias("nz"))
    packed = packed.select("image_id", "nx", "ny", "nz", F.col("c.re").alias("re"), F.col("c.im").alias("im"), F.transform("c", lambda _: F.lit(1)).alias("mask"))
    got = unpack(fourier.fft(packed) if n.kind == "fft" else fourier.ifft(packed))
    return rows.join(got.select("image_id", "i", F.col("re").alias(f"re{number}"), F.col("im").alias(f"im{number}"), F.col("mask").alias(f"mask{number}")), ["image_id", "i"])


def _without_transforms(rows: DataFrame, n: Node, number: int) -> tuple[DataFrame, Node, int]:
    """The innermost transforms first become variables from `number` on."""
    args = []
    for x in n.args:
        rows, x, number = _without_transforms(rows, x, number)
        args.append(x)
    n = Node(n.kind, tuple(args), n.value)
    if n.kind not in ("fft", "ifft"):
        return rows, n, number
    return _transformed(rows, n, number), Node("image", value=number), number + 1


def evaluate(text: str, *images: DataFrame) -> DataFrame:
    """The pixel table of an expression; images are pixel tables of equal image_id and index, zipped by an equi-join."""
    tree = parse(text)
    for k in images_of(tree):
        if k >= len(images):
            raise ExpressionError(f"no image for variable number {k + 1}")
    out = None
    for k, px in enumerate(images):
        part = px.select("image_id", "i", *([] if k else ["x", "y", "z"]), F.col("re").alias(f"re{k}"), F.col("im").alias(f"im{k}"), F.col("mask").alias(f"mask{k}"))
        out = part if out is None else out.join(part, ["image_id", "i"])
    out, tree, _ = _without_transforms(out, tree, len(images))
    a, b, m = compile_node(tree)
    return out.select("image_id", "i", "x", "y", "z", a.alias("re"), b.alias("im"), m.alias("mask"))


def select_pixels(text: str, *images: DataFrame) -> DataFrame:
    """The pixels where an expression isn't 0."""
    return evaluate(text, *images).where(F.hypot("re", "im") != 0)


# ---- over packed rows


def _parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.real(v), np.imag(v)


def _power(a, e: complex):
    size, angle = np.abs(a), np.angle(a)
    with np.errstate(divide="ignore", invalid="ignore"):
        ln = np.log(np.where(size > 0, size, 1))
        out = np.exp(e.real * ln - e.imag * angle) * np.exp(1j * (e.imag * ln + e.real * angle))
    return np.where(size > 0, out, 1.0 if e == 0 else 0.0)


def _quotient(a, b, scalar: bool):
    zero = np.abs(b) == 0
    return np.where(zero, 0.0 if scalar else np.nan, np.multiply(a, np.conj(b)) / np.where(zero, 1, np.abs(b) ** 2))


def compute(n: Node, images: list[np.ndarray], masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Complex values and mask of a tree over arrays of images, (images, [z,] y, x); what compile_node() says of pixels, and transforms as well."""
    from ..operators.fourier import fftn, ifftn

    whole = images[0]
    within = tuple(range(1, whole.ndim))
    spread = lambda v: np.broadcast_to(np.asarray(v, complex), whole.shape)
    if n.kind == "number":
        return np.complex128(n.value), np.int32(1)
    if n.kind == "image":
        return images[n.value], masks[n.value]
    if n.kind in USER:
        raise ExpressionError(f"{n.kind} is a function of pixel tables, of evaluate()")
    if n.kind in ("posx", "posy", "posz", "mask", "set_mask", "fft", "ifft") and is_scalar(n.args[0]):
        raise ExpressionError(f"{n.kind} takes an image")
    values = [compute(x, images, masks) for x in n.args]
    a, m = values[0]
    size = np.abs(a)
    if n.kind in ("fft", "ifft"):
        return (fftn(spread(a)) if n.kind == "fft" else ifftn(spread(a)) * whole[0].size), np.ones(whole.shape, np.int32)
    if n.kind in ("posx", "posy", "posz"):
        axis = -1 - "xyz".index(n.kind[-1])
        if axis < -(whole.ndim - 1):
            return np.zeros(whole.shape, complex), m
        shape = [1] * whole.ndim
        shape[axis] = -1
        return spread(np.arange(whole.shape[axis]).reshape(shape)), m
    with np.errstate(divide="ignore", invalid="ignore"):
        one = {
            "neg": lambda: -a, "times_i": lambda: 1j * a, "mask": lambda: m + 0j, "abs": lambda: size + 0j, "arg": lambda: np.angle(a) + 0j, "re": lambda: np.real(a) + 0j, "im": lambda: 1j * np.imag(a), "conj": lambda: np.conj(a),
            "exp": lambda: np.exp(a), "sqrt": lambda: np.sqrt(size) * np.exp(0.5j * np.angle(a)),
            "log": lambda: np.where(size > 0, np.log(np.where(size > 0, size, 1)), -np.inf) + 1j * np.angle(a),
            "sum": lambda: a if is_scalar(n.args[0]) else spread(spread(a).sum(within, keepdims=True)),
        }.get(n.kind)
        if one:
            return one(), m
        b, m2 = values[1]
        other = np.abs(b)
        if n.kind == "set_mask":
            return spread(a), np.floor(np.broadcast_to(other, whole.shape)).astype(np.int32)
        m = m2 if is_scalar(n.args[0]) else m
        if n.kind == "if":
            return np.where(size != 0, b, values[2][0]), m
        if n.kind == "/":
            return _quotient(a, b, is_scalar(n.args[1])), m
        if n.kind == "^":
            if not is_scalar(n.args[1]):
                raise ExpressionError("the exponent must be a number, not an image")
            return _power(a, complex(b)), m
        if n.kind in ("min", "max"):
            pick = np.minimum if n.kind == "min" else np.maximum
            return pick(np.real(a), np.real(b)) + 1j * pick(np.imag(a), np.imag(b)), m
        truth = {"<": lambda: size < other, ">": lambda: size > other, "==": lambda: (np.real(a) == np.real(b)) & (np.imag(a) == np.imag(b)), "&&": lambda: (size != 0) & (other != 0), "||": lambda: (size != 0) | (other != 0)}.get(n.kind)
        if truth:
            return truth() + 0j, m
        return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[n.kind](), m


def evaluate_packed(text: str, *images: DataFrame) -> DataFrame:
    """evaluate() over packed rows: images of equal id meet on it, and nothing else is shuffled, however many sums and transforms there are. Where a pixel table has null (an image divided by its zeros), it is nan."""
    from ..model import PACKED
    from ..operators.fourier import complex_of, packed_batch, shaped

    tree, count = parse(text), len(images)
    for k in images_of(tree):
        if k >= count:
            raise ExpressionError(f"no image for variable number {k + 1}")
    compute(tree, *[[np.ones((1, 1, 1), t)] * count for t in (complex, np.int32)])  # what can't be computed is an error now, not in tasks
    joined = images[0].select("image_id", "nx", "ny", "nz", *[F.col(c).alias(f"{c}0") for c in ("re", "im", "mask")])
    for k, other in enumerate(images[1:], 1):
        joined = joined.join(other.select("image_id", *[F.col(c).alias(f"{c}{k}") for c in ("re", "im", "mask")]), "image_id")

    def run(batches):
        for rows, shape in shaped(batches):
            values = [complex_of(rows, shape, f"re{k}", f"im{k}") for k in range(count)]
            masks = [rows.column(rows.schema.get_field_index(f"mask{k}")).flatten().to_numpy(zero_copy_only=False).reshape(values[0].shape) for k in range(count)]
            v, m = compute(tree, values, masks)
            v = np.broadcast_to(np.asarray(v, complex), values[0].shape)
            yield packed_batch(rows.column(0), v, np.broadcast_to(m, v.shape))

    return joined.mapInArrow(run, PACKED)
