"""Quality classifier: a weak-label model whose posteriors train a hashed linear scorer.

Two aspects are judged, form (is this running text?) and civility (is it free of abuse?).
For each, heuristic labellers vote good, bad or nothing on every document.  Documents are
counted by the pattern of their votes - at most 3 ** labellers patterns, whatever the size
of the corpus - and expectation-maximisation over those counts estimates how often each
labeller votes what on good and on bad documents, so all documents take part.  The
posterior of a pattern is the weak label of its documents.

Two civility labellers know words that labelled abusive documents share (a bounded sample of
``labels``, see ``learn_abuse``); all other labellers are fixed rules.  The model takes labellers to err
independently of each other.  Those of civility don't quite: some are cuts of one list, so that evidence
counts more than once.  Labellers that part the words among them were tried, and rejected more clean and
fewer abusive held-out documents (figures in the README).

Texts pass through Python twice, for the votes and for the scores; the labelled and the sampled rows
are picked before.

Weak labels of a bounded sample (``SAMPLE_DOCS`` in each class and aspect, drawn by a hash
of the id) train one logistic scorer over hashed features for each aspect; the scorer then
judges every document from its whole text.  A document is kept if both scores are at
least one half.

Edge cases: text without words (null, empty, blank) has the scores 0 and 1 and is
rejected; with no documents of a class the scorer follows the prior; repeated rows are
judged alike, as are rows without an id; very long texts are read whole; an empty table gives an
empty result; columns of any other name play no part, and all stay in ``keep_good``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 1 << 18
SAMPLE_DOCS = 3000
LABELLED_DOCS = 5000
MIN_DOCS = 4
SCREEN = 5.0  # standard deviations
SURE = 12.0  # log-likelihood ratio of a word of abuse, within its language
LIFT = 100.0  # and how many times as often abusive documents have it
ROUNDS = 250
CACHE_WORDS = 50_000

_STOP = frozenset(
    """the of and to in a is that it for was on are as with his they at be this from have or by one had not but what
    all were when we there can an your which their said if do will each how them he she you i my so no who
    der die das und ist von mit den zu sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie
    nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch
    le la les de des et en un une du que qui dans est pour pas sur au par il ce plus ne se sont avec son on ou mais sa
    aux elle cette ces nous vous leur été être fait
    el los las y del se por con para una su al lo como más pero sus le ha me si sin sobre este ya entre cuando
    muy también hasta hay donde quien desde todo nos durante uno ni contra otros ese eso""".split()
)
_STOP_ENGLISH = frozenset(
    """the of and to is that it for with his they this from have by one had not but what all were when we there can your
    which their said if do will each how them he she you my so no who""".split()
)
_ABUSE_NOUNS = frozenset(
    """idiot idiots moron morons loser losers clown clowns scum trash garbage fool fools jerk jerks imbecile cretin
    dumbass bastard bastards bitch whore slut pig pigs vermin parasite parasites freak freaks coward dimwit halfwit
    asshole dickhead scumbag lowlife degenerate simpleton dunce twat wanker prick dumb""".split()
)
_ABUSE_WORDS = frozenset(
    """stupid pathetic worthless disgusting dumb ugly useless filthy brainless retarded despicable vile revolting
    repulsive contemptible braindead hateful damn fucking fuck shit shitty crap hate kill die scum trash""".split()
) - {"die"}
_ABUSE_STRONG = frozenset(
    """idiot moron loser clown scum worthless pathetic disgusting stupid trash imbecile scumbag asshole bastard bitch
    cretin vermin despicable retarded dumbass""".split()
)
_SYMBOLS = b"#$%&*~^|<>=+{}[]\\_@"
_STRIP = "\t\n\r .,;:!?\"'()[]{}#$%&*~^|<>=+_@«»“”„¿¡-"


def _grade(x: float, good: float, bad: float) -> str:
    """Vote of a measure that is high on bad text."""
    return "+" if x <= good else "-" if x >= bad else "0"


@dataclass
class Facts:
    """What the labellers look at, from the whole text."""

    text: str
    words: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.words = self.text.split()

    def form(self) -> str:
        text, words, n = self.text, self.words, len(self.words)
        raw = text.encode()
        count = lambda chars: len(raw) - len(raw.translate(None, chars))
        upper = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        lower = count(b"abcdefghijklmnopqrstuvwxyz")
        kinds = set(words)
        distinct = len(kinds) / n
        stops = sum(map(_STOP.__contains__, words)) / n
        marks = {w for w in kinds if not (w[0].isalnum() or w[-1].isalnum() or any(map(str.isalnum, w)))}
        bare = sum(map(marks.__contains__, words)) / n if marks else 0
        ends = sum(w[-1] in ".,;:?" for w in words) / n
        lines = [x for x in text.split("\n") if x.strip()]
        return "".join(
            [
                _grade(count(_SYMBOLS) / n, 0.05, 0.2),
                _grade(upper / max(1, upper + lower), 0.25, 0.5),
                _grade(raw.count(b"!") / n, 0.05, 0.2),
                _grade(sum(map(eq, words, words[1:])) / n, 0.03, 0.15),
                "0" if n < 60 else _grade(1 - distinct, 0.7, 0.85),
                "0" if n < 20 else _grade(-stops, -0.06, -0.02),
                _grade(bare, 0.05, 0.2),
                "0" if n < 20 else "+" if 0.015 <= ends <= 0.3 else "-",
                "0" if len(lines) < 3 else _grade(1 - len(set(lines)) / len(lines), 0.3, 0.6),
            ]
        )

    def civility(self, known: frozenset[str]) -> str:
        found = {w.strip(_STRIP) for w in set(self.text.lower().split())}
        nouns, words, strong = len(found & _ABUSE_NOUNS), len(found & _ABUSE_WORDS), len(found & _ABUSE_STRONG)
        whole = len(found & known)
        stems = sum(w[:4] + "*" in known or w[:5] + "*" in known for w in found)
        # the fixed lists are English: on other text, that they find nothing tells nothing
        foreign = len(found & (_STOP - _STOP_ENGLISH)) > len(found & _STOP_ENGLISH)
        listed = "".join("-" if x else "0" if foreign else "+" for x in (nouns, words, strong, nouns + words > 1))
        return listed + "".join("-" if x else "+" for x in (whole, stems, whole + stems > 2))


ASPECTS = ("form", "civility")


# weak-label model


@dataclass
class WeakModel:
    """Two-class model of labellers that err independently of each other."""

    posterior: dict[str, float]
    prior: float
    votes: np.ndarray  # labeller, class (bad, good), vote (-, +)


def fit_weak_model(patterns: dict[str, int], rounds: int = 100) -> WeakModel:
    """Expectation-maximisation over counts of vote patterns."""
    if not patterns:
        return WeakModel({}, 0.5, np.zeros((0, 2, 2)))
    keys = sorted(patterns)
    v = np.array([["-0+".index(c) for c in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    m = v.shape[1]
    votes = np.empty((m, 2, 2))
    votes[:, 0], votes[:, 1] = (0.6, 0.4), (0.05, 0.95)
    prior = 0.8
    says = [np.flatnonzero(v[:, j] != 1) for j in range(m)]  # an abstention tells nothing
    pick = [v[says[j], j] // 2 for j in range(m)]
    for _ in range(rounds):
        odds = np.full(len(keys), np.log(prior) - np.log(1 - prior))
        for j in range(m):
            odds[says[j]] += np.log(votes[j, 1, pick[j]]) - np.log(votes[j, 0, pick[j]])
        post = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 1e-4, 1 - 1e-4))
        for j in range(m):
            for c, weight, pseudo in ((0, n * (1 - post), (1.0, 0.5)), (1, n * post, (0.5, 1.0))):
                count = np.bincount(pick[j], weight[says[j]], 2) + pseudo
                votes[j, c] = count / count.sum()
    return WeakModel(dict(zip(keys, post.tolist())), prior, votes)


def stems(text: str) -> set[str]:
    """The words of a text, and their stems of four and five letters (marked with a star)."""
    words = {w.strip(_STRIP) for w in set(text.lower().split())}
    return words | {w[:k] + "*" for w in words for k in (4, 5) if len(w) > k}


def learn_abuse(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, limit: int) -> frozenset[str]:
    """Words and stems that labelled abusive documents share and others don't have, from at most
    about ``limit`` labelled rows of either kind.

    Each language (column ``lang``, if there is one) is judged by itself: a word counts if its share of
    abusive documents is beyond chance, by a likelihood ratio, and beyond its share of the others, there
    and in all languages.  So neither the table's size nor other languages set how many are needed.
    """
    n = {bool(r[0]): r[1] for r in labels.where("toxic is not null").groupBy(F.col("toxic") > 0).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit("labels")), F.lit(1 << 40)) / float(1 << 40)
    share = F.when(F.col("toxic") > 0, min(1.0, limit / n.get(True, 1))).otherwise(min(1.0, limit / n.get(False, 1)))
    some = labels.where(draw < share).select(F.col(f"`{id_col}`").alias("id"), (F.col("toxic") > 0).alias("toxic"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang"))
    texts = texts.where("text is not null")
    rows = texts.join(F.broadcast(some.where("toxic is not null").dropDuplicates(["id"])), "id")  # bounded by limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole):
                found, bad, lang = [], [], []
                for text, toxic, code in zip(*(col.to_pylist() for col in batch.columns)):
                    s = [None, *stems(text)]  # the row without a stem counts documents
                    found += s
                    bad += [toxic] * len(s)
                    lang += [code] * len(s)
                t = pa.table({"stem": pa.array(found, pa.string()), "toxic": pa.array(bad, pa.bool_()), "lang": lang})
                t = t.group_by(["stem", "toxic", "lang"]).aggregate([([], "count_all")])
                yield from t.rename_columns(["stem", "toxic", "lang", "n"]).combine_chunks().to_batches()

    counts = rows.select("text", "toxic", "lang").mapInArrow(run, "stem string, toxic boolean, lang string, n bigint")
    bad = F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0))
    good = F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n")))
    table = counts.groupBy("stem", "lang").agg(bad.alias("bad"), good.alias("good")).checkpoint()
    sizes = table.where("stem is null").select("lang", F.col("bad").alias("n_bad"), F.col("good").alias("n_good"))
    everywhere = sizes.agg(F.sum("n_good")).first()[0] or 0
    stem = table.where("stem is not null").withColumn("good_all", F.sum("good").over(Window.partitionBy("stem")))
    stem = stem.where("bad > 1").join(F.broadcast(sizes), "lang")  # one row a language
    b, g, n_b, n_g = (F.col(c).cast("double") for c in ("bad", "good", "n_bad", "n_good"))
    has, n = b + g, n_b + n_g
    ratio = F.lit(0.0)
    for seen, due in ((b, has * n_b), (g, has * n_g), (n_b - b, (n - has) * n_b), (n_g - g, (n - has) * n_g)):
        ratio += F.when(seen > 0, 2 * seen * F.log(seen * n / due)).otherwise(0.0)
    among = F.greatest(g / n_g, F.col("good_all") / F.lit(max(everywhere, 1)))
    picked = stem.where((n_g > 0) & (ratio >= SURE) & (b / n_b > LIFT * among))
    return frozenset(r[0] for r in picked.select("stem").distinct().collect())  # of what bounded rows hold


def vote_table(docs: DataFrame, id_col: str, text_col: str, known: frozenset[str]) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        form, civil = [], []
        for text in batch.column(1).to_pylist():
            facts = Facts(text or "")
            form.append(facts.form() if facts.words else None)
            civil.append(facts.civility(known) if facts.words else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(form, pa.string()), pa.array(civil, pa.string())], ["id", "form", "civility"]
        )

    return common.map_batches(docs, [id_col, text_col], rows, f"id {kind}, form string, civility string")


# hashed linear scorer

_RUNS = re.compile(r"(.)\1+", re.DOTALL)


def _slot(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) & (DIMENSIONS - 1)


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, runs shortened to one."""
    core = word.rstrip(".,;:?!")
    tail = word[len(core) :]
    if core.isalpha():
        if core.islower():
            return "a" + tail
        if core.isupper():
            return "A" + tail
        if core[0].isupper() and core[1:].islower():
            return "Aa" + tail
    mapped = "".join(
        "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "l" if c.isalpha() else c for c in word
    )
    return _RUNS.sub(r"\1", mapped)


_REPEATED = _slot("repeated word")
_REPEATED_LINE = _slot("repeated line")
_STOPS = _slot("function word")


def form_slots(word: str) -> tuple[int, ...]:
    return (_slot("s" + shape(word)), *((_STOPS,) if word in _STOP else ()))


def civil_slots(word: str) -> tuple[int, ...]:
    w = word.lower().strip(_STRIP)
    return (_slot("w" + w), *(_slot(w[:k] + "*") for k in (4, 5) if len(w) > k))


def _line_repeats(text: str) -> float:
    lines = [x for x in text.split("\n") if x.strip()]
    return 1 - len(set(lines)) / len(lines) if lines else 0.0


def features(text: str) -> tuple[dict[int, float], set[int]]:
    """Sparse form features (rates, times 10), and present civility slots, for training."""
    words = text.split()
    form: dict[int, float] = {}
    civil = set()
    unit = 10 / len(words)
    for w in words:
        for s in form_slots(w):
            form[s] = form.get(s, 0.0) + unit
    for w in set(words):
        civil.update(civil_slots(w))
    form[_REPEATED] = unit * sum(map(eq, words, words[1:]))
    form[_REPEATED_LINE] = 10 * _line_repeats(text)
    return form, civil


def _sums(slot: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
    """Sums of weights (None: counts) by slot, some at a time."""
    out = np.zeros(DIMENSIONS)
    for at in range(0, len(slot), 1 << 19):
        part = slice(at, at + (1 << 19))
        out += np.bincount(slot[part], None if weight is None else weight[part], DIMENSIONS)
    return out


def fit_scorer(
    size: np.ndarray, slot: np.ndarray, val: np.ndarray | None, y: np.ndarray, decay: float, screen: float = 0.0,
    rounds: int = ROUNDS,
) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights and bias of a logistic scorer, by full-batch Adam on soft labels.

    Documents have ``size`` slots each, one after the other in ``slot``, with values (None: one).
    """
    if not len(y):
        return np.zeros(0, np.int64), np.zeros(0), 1.0
    row = np.repeat(np.arange(len(y), dtype=np.int32), size)
    # slots in few documents tell nothing about new text; nor, if asked for, do slots spread over both classes
    n = _sums(slot, None)
    telling = n >= MIN_DOCS
    if screen:
        rate = float(np.clip(1 - y.mean(), 1e-6, 1 - 1e-6))
        bad = _sums(slot, (1 - y).astype(np.float32)[row])
        telling &= np.abs(bad - n * rate) >= screen * np.sqrt(np.maximum(n, 1) * rate * (1 - rate))
    often = np.flatnonzero(telling[slot])
    row = row[often]
    val = np.ones(len(often)) if val is None else val[often]
    used, col = np.unique(slot[often], return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    m1, m2, b1, b2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    good = max(y.sum(), 1e-9)
    weight = y * (len(y) / 2 / good) + (1 - y) * (len(y) / 2 / max(len(y) - good, 1e-9))
    if min(good, len(y) - good) < 1:
        weight = np.ones(len(y))
    for t in range(1, rounds + 1):
        z = np.bincount(row, val * w[col], len(y)) + bias
        d = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        g, gb = np.bincount(col, val * d[row], len(used)) + decay * w, d.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        step = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= step * m1 / (np.sqrt(m2) + 1e-8)
        bias -= step * b1 / (np.sqrt(b2) + 1e-8)
    return used, w, float(bias)


class Scorer:
    """Both scorers, with the summed weights of each word at hand."""

    def __init__(self, form, civil) -> None:
        self.form, self.civil = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        self.form[form[0]], self.form_bias = form[1], form[2]
        self.civil[civil[0]], self.civil_bias = civil[1], civil[2]
        shapes = _Weights(lambda s: float(self.form[_slot("s" + s)]))
        stop = float(self.form[_STOPS])
        self.form_of = _Weights(lambda w: shapes[shape(w)] + (stop if w in _STOP else 0.0))
        live = frozenset(np.flatnonzero(self.civil).tolist())
        stems_of = _Weights(
            lambda w: tuple(s for s in (_slot(w[:k] + "*") for k in (4, 5) if len(w) > k) if s in live)
        )

        def slots(word: str) -> tuple[int, ...]:
            w = word.lower().strip(_STRIP)
            s = _slot("w" + w)
            return (s, *stems_of[w[:6]]) if s in live else stems_of[w[:6]]

        self.slots_of = _Weights(slots)

    def __call__(self, text: str | None) -> tuple[float, float]:
        words = text.split() if text else []
        n = len(words)
        if not n:
            return 0.0, 1.0
        form = sum(map(self.form_of.__getitem__, words)) * 10 / n + self.form_bias
        form += float(self.form[_REPEATED]) * 10 / n * sum(map(eq, words, words[1:]))
        form += float(self.form[_REPEATED_LINE]) * 10 * _line_repeats(text)
        slots = set(chain.from_iterable(map(self.slots_of.__getitem__, set(words))))
        # sorted: a set's order differs between workers, and with it the last digits of the sum
        civil = float(self.civil[np.sort(np.fromiter(slots, np.int64, len(slots)))].sum()) + self.civil_bias
        return tuple(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))) for z in (form, civil))


class _Weights(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = value
        return value


@dataclass
class Classifier:
    weak: dict[str, WeakModel]
    form: tuple
    civil: tuple


def fit(
    docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS, labelled_docs: int = LABELLED_DOCS,
) -> Classifier:
    """Fit the weak-label models on all documents and the scorers on a sample of at most about
    ``sample_docs`` documents in each class of each aspect.

    ``labels`` (id and toxic), if given, teach two of the civility labellers their words, from at
    most about ``labelled_docs`` rows of either class.
    """
    common.prepare(docs.sparkSession)
    known = learn_abuse(docs, labels, id_col, text_col, labelled_docs) if labels is not None else frozenset()
    votes = vote_table(docs, id_col, text_col, known).where("form is not null").checkpoint()
    weak, size = {}, {}
    for aspect in ASPECTS:
        counts = {r[0]: r[1] for r in votes.groupBy(aspect).count().collect()}  # at most 3 ** labellers rows
        weak[aspect] = fit_weak_model(counts)
        for k, c in counts.items():
            key = aspect, weak[aspect].posterior[k] >= 0.5
            size[key] = size.get(key, 0) + c
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    picked = F.lit(False)
    for aspect in ASPECTS:
        good = F.col(aspect).isin([k for k, p in weak[aspect].posterior.items() if p >= 0.5])
        for side, test in ((True, good), (False, ~good)):
            share = min(1.0, sample_docs / size.get((aspect, side), 1))
            picked = picked | (test & (draw < share))
    sample = votes.where(picked)
    # the sample is bounded by the parameter: four times sample_docs
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(
        F.broadcast(sample.dropDuplicates(["id"])), "id"
    )
    posterior = {a: weak[a].posterior for a in ASPECTS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in common.slices(whole):
                out = {"key": [], "fs": [], "fv": [], "cs": [], "form": [], "civil": []}
                for i, text, f, c in zip(*(col.to_pylist() for col in batch.columns)):
                    form, civil = features(text)
                    out["key"].append(str(i))
                    out["fs"].append(sorted(form))
                    out["fv"].append([form[k] for k in sorted(form)])
                    out["cs"].append(sorted(civil))
                    out["form"].append(posterior["form"][f])
                    out["civil"].append(posterior["civility"][c])
                yield pa.RecordBatch.from_pydict(
                    out,
                    schema=pa.schema(
                        [("key", pa.string()), ("fs", pa.list_(pa.int32())), ("fv", pa.list_(pa.float32())),
                         ("cs", pa.list_(pa.int32())), ("form", pa.float64()), ("civil", pa.float64())]
                    ),
                )

    rows = chosen.select("id", "text", "form", "civility").mapInArrow(
        run, "key string, fs array<int>, fv array<float>, cs array<int>, form double, civil double"
    ).toArrow().combine_chunks().sort_by("key")
    lists = {c: rows.column(c).combine_chunks() for c in ("fs", "fv", "cs")}
    size = {c: np.diff(x.offsets.to_numpy()) for c, x in lists.items()}
    flat = {c: x.flatten().to_numpy() for c, x in lists.items()}
    y = {c: rows.column(c).to_numpy() for c in ("form", "civil")}
    form = fit_scorer(size["fs"], flat["fs"], flat["fv"], y["form"], 1e-5)
    civil = fit_scorer(size["cs"], flat["cs"], None, y["civil"], 1e-5, SCREEN)
    return Classifier(weak, form, civil)


def score(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: form and civility score, and whether it is kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = _ship(docs.sparkSession, model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _scorer(shipped)
        scores = [scorer(t) for t in batch.column(1).to_pylist()]
        form, civil = [s[0] for s in scores], [s[1] for s in scores]
        kept = [f >= 0.5 and c >= 0.5 for f, c in scores]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(form, pa.float64()), pa.array(civil, pa.float64()), pa.array(kept, pa.bool_())],
            [id_col, "form_score", "civility_score", "kept"],
        )

    fields = f"`{id_col}` {kind}, form_score double, civility_score double, kept boolean"
    return common.map_batches(docs, [id_col, text_col], rows, fields)


_SCORERS: dict[str, Scorer] = {}


def _ship(spark, model: Classifier):
    """Broadcast both scorers, at most DIMENSIONS weights each, under a digest."""
    parts = [x for head in (model.form, model.civil) for x in head]
    digest = common.sha256_hex(b"".join(np.asarray(x).tobytes() for x in parts))
    return spark.sparkContext.broadcast((digest, model.form, model.civil))


def _scorer(shipped) -> Scorer:
    """A worker builds a scorer once and keeps the last one."""
    digest, form, civil = shipped.value
    if digest not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[digest] = Scorer(form, civil)
    return _SCORERS[digest]


def keep_good(docs: DataFrame, labels: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text"):
    """The documents that the classifier keeps, with all their columns."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    shipped = _ship(docs.sparkSession, model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(shipped)
        for whole in batches:
            for batch in common.slices(whole):
                kept = [min(scorer(t)) >= 0.5 for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
