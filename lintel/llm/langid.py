"""Language identification by a byte convolutional network (operator 3).

Bytes are embedded, filters of several widths run over fixed-length windows,
each filter is max-pooled and a softmax layer scores the languages.  The
network is trained in numpy on windows drawn from a bounded, stratified sample
of labelled texts (``PER_LANG`` texts a language, ``DRAWS`` windows each, from
anywhere in the text).  A text is cut into overlapping windows that cover all
of it, handled ``WINDOWS`` at a time, and the windows' probabilities are
averaged by their number of bytes.

Defined cases: a text that is null or holds no letter is ``und`` with score 0;
a table without a usable labelled text gives ``und`` throughout; repeated rows
get the same answer; extra columns of any name are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBED = 16, 8
PER_LANG, DRAWS = 500, 2
EPOCHS, BATCH, RATE = 6, 64, 0.01
WINDOWS = 512
ROWS = 256
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}").search


class ByteCNN:
    """Parameters and passes of the network; training works on argmax places only."""

    def __init__(self, langs: list[str], seed: int = 7):
        rnd = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"E": rnd.normal(0, 0.5, (256, EMBED)), "V": rnd.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))),
                  "c": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"W{w}"] = rnd.normal(0, (2 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width and offset, what a byte adds to each filter (float32)."""
        return {w: [(self.p["E"] @ self.p[f"W{w}"][k]).astype(np.float32) for k in range(w)] for w in WIDTHS}

    def pooled(self, x: np.ndarray, tables: dict[int, list[np.ndarray]], places: bool = False):
        """Max-pooled filters of windows ``x`` (n, length); with ``places`` their argmax too."""
        out, at = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            y = tables[w][0][x[:, :n]]
            for k in range(1, w):
                y += tables[w][k][x[:, k:k + n]]
            if places:
                at.append(y.argmax(1))
            out.append(np.maximum(y.max(1) + self.p[f"b{w}"], 0))
        z = np.concatenate(out, 1)
        return (z, at) if places else z

    def softmax(self, z: np.ndarray) -> np.ndarray:
        s = z @ self.p["V"] + self.p["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rnd = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rnd.permutation(len(x))
            for a in range(0, len(x), BATCH):
                xb, yb = x[order[a:a + BATCH]], y[order[a:a + BATCH]]
                grad, step = self._gradient(xb, yb), step + 1
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] -= RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, at = self.pooled(x, self.tables(), places=True)
        d = self.softmax(z)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"V": z.T @ d, "c": d.sum(0), "E": np.zeros_like(self.p["E"])}
        dz = (d @ self.p["V"].T) * (z > 0)
        for i, w in enumerate(WIDTHS):
            part, place = dz[:, i * FILTERS:(i + 1) * FILTERS], at[i]
            g[f"b{w}"] = part.sum(0)
            gw = np.zeros_like(self.p[f"W{w}"])
            for k in range(w):
                byte = np.take_along_axis(x, place + k, 1)                      # (n, filters)
                gw[k] = np.einsum("nfe,nf->ef", self.p["E"][byte], part)
                np.add.at(g["E"], byte, part[:, :, None] * self.p[f"W{w}"][k].T[None])
            g[f"W{w}"] = gw
        return g


def windows(data: bytes) -> np.ndarray:
    """Overlapping windows over all of ``data``; the last is padded with zeros."""
    step = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    flat = np.zeros((n - 1) * step + WINDOW, np.uint8)
    flat[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::step]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_lang: int = PER_LANG) -> ByteCNN | None:
    """Fit on a bounded sample: about ``per_lang`` texts a language, never more than twice that."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang_col).count().collect()}   # one row a language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_lang / n))])
    luck = F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1_000_003)) / 1_000_003
    room = F.greatest(F.lit(1), F.char_length(text_col) - WINDOW)
    draws = F.array(*[F.substr(F.col(text_col), 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(j)), room).cast("int"),
                               F.lit(WINDOW)) for j in range(DRAWS)])
    rows = (usable.where(luck < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), draws.alias("w"))
            .limit(2 * per_lang * len(sizes)).collect())
    langs = sorted(sizes)
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r["lang"], r["w"])):
        for w in r["w"]:
            x.append(windows(w.encode("utf-8"))[0])
            y.append(langs.index(r["lang"]))
    net = ByteCNN(langs)
    net.fit(np.array(x), np.array(y))
    return net


def predict(docs: DataFrame, net: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(net)   # some tens of KB

    def run(batches):
        net = sent.value
        tables = net.tables() if net else None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                texts = part.column(1).to_pylist()
                langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                total = np.zeros((len(texts), len(net.langs))) if net else None
                held, owner, n = [], [], 0

                def flush():
                    prob = net.softmax(net.pooled(np.concatenate(held), tables))
                    np.add.at(total, np.concatenate(owner), prob)

                for i, t in enumerate(texts):
                    if not net or not t or not LETTER(t):
                        continue
                    w = windows(t.encode("utf-8", "surrogatepass"))
                    for b in range(0, len(w), WINDOWS):
                        held.append(w[b:b + WINDOWS])
                        owner.append(np.full(len(held[-1]), i))
                        n += len(held[-1])
                        if n >= WINDOWS:
                            flush()
                            held, owner, n = [], [], 0
                if n:
                    flush()
                if net:
                    mass = total.sum(1)
                    for i in np.flatnonzero(mass > 0):
                        best = int(total[i].argmax())
                        langs[i], scores[i] = net.langs[best], float(total[i, best] / mass[i])
                yield pa.record_batch([part.column(0), pa.array(langs), pa.array(scores, pa.float64())],
                                      ["id", "lang_pred", "score"])

    return src.mapInArrow(run, f"id {kind}, lang_pred string, score double")
