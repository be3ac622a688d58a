"""The BiLSTM-CRF against finite differences and brute force, and the mentions against held-out accuracy."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from spanloom.llm import pii, train_pii
from spanloom.llm._chars import Joined
from spanloom.llm.bilstm import SYMBOLS, TAGS, Model, allowed, gradients, symbol_table, train, viterbi


def test_gradients():
    m, r = Model.new(5, 0), np.random.default_rng(0)
    x, y = r.integers(0, SYMBOLS, (3, 8)).astype(np.uint8), np.zeros((3, 8), np.int64)
    y[0, 2], y[0, 3:5], y[2, 7] = 1, 2, 5
    _, g = gradients(m, x, y)
    for k in m.NAMES:
        value = getattr(m, k)
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = value[at]
        value[at] = keep + 1e-2
        up = gradients(m, x, y)[0]
        value[at] = keep - 1e-2
        down = gradients(m, x, y)[0]
        value[at] = keep
        assert g[k][at] == pytest.approx((up - down) / 2e-2, rel=2e-2)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    t = np.where(allowed(), r.normal(size=(TAGS, TAGS)), -30).astype(np.float32)
    e = r.normal(size=(4, 4, TAGS)).astype(np.float32) * 2
    e[:, :, 7:] -= 50
    got, came = viterbi(e, np.array([4, 3, 1, 2]), t)
    assert not came.any()
    for w, n in enumerate((4, 3, 1, 2)):
        def score(path):
            s = t[0, path[0]] + e[w, 0, path[0]] - (30 if path[0] and path[0] % 2 == 0 else 0)
            for i in range(1, len(path)):
                s += t[path[i - 1], path[i]] + e[w, i, path[i]]
            return s + t[path[-1], 0]

        best = max(product(range(7), repeat=n), key=score)
        assert tuple(got[w, :n]) == best


@pytest.mark.parametrize("seed", range(12))
def test_zones_give_the_best_path_of_the_whole(seed):
    """Random scores, from clear ones to ones that are clear nowhere, and transitions of all kinds."""
    r = np.random.default_rng(seed)
    t = np.where(allowed(), r.normal(size=(TAGS, TAGS)) * r.choice([0.5, 2.0]), -30).astype(np.float32)
    texts = ["x" * int(n) for n in r.integers(0, 60, 200)]
    joined = Joined(texts)
    e = r.normal(size=(len(joined.codes), TAGS)).astype(np.float32) * r.choice([1.0, 3.0])
    e[:, 0] += np.repeat(r.choice([0.0, 4.0, 12.0], -(-len(e) // 7)), 7)[: len(e)]
    e[joined.ends] = 0
    short, whole = pii.best_path(e, joined, t), pii.best_path(e, joined, t, whole=True)

    def score(tags, a, b):
        path = [0, *tags[a:b].tolist(), 0]
        return sum(float(t[x, y]) for x, y in zip(path, path[1:], strict=False)) + float(sum(e[a + i, x] for i, x in enumerate(path[1:-1])))

    for a, b in zip(joined.starts.tolist(), joined.ends.tolist(), strict=True):
        assert (short[a:b] == whole[a:b]).all() or score(short, a, b) == pytest.approx(score(whole, a, b), abs=1e-3)


def test_real_texts_decode_alike_with_and_without_zones(held_out):
    texts, _ = held_out
    m = Model.load(pii.MODEL)
    joined = Joined(texts[:400])
    assert pii.decode(m, joined) == pii.decode(m, joined, whole=True)


def test_windows_agree_with_one_pass():
    m, r = Model.new(6, 2), np.random.default_rng(2)
    long = "".join(map(chr, r.integers(32, 127, 5000)))
    for texts in ([long], ["a", long, "", long[:1500]]):
        joined = Joined(texts)
        symbols = symbol_table()[joined.codes]
        symbols[joined.ends] = 0
        stitched = pii._scores(m, symbols, joined)
        for a, b in zip(joined.starts, joined.ends, strict=True):
            if a < b:
                assert np.abs(m.emissions(symbols[None, a:b])[0] - stitched[a:b]).mean() < 0.05


def test_mentions_depend_on_the_text_alone(held_out):
    """Other neighbours, another order, other batches: the same mentions."""
    texts, _ = held_out
    texts = [*texts[:600], "x" * 3000 + " reply to ab.cd@efg.test", ""]
    m = Model.load(pii.MODEL)
    whole = pii.find(texts, m)
    order = np.random.default_rng(5).permutation(len(texts)).tolist()
    mixed = pii.find([texts[i] for i in order], m)
    assert [mixed[order.index(i)] for i in range(len(texts))] == whole
    assert [x for i in range(0, len(texts), 37) for x in pii.find(texts[i : i + 37], m)] == whole


def test_training_lowers_the_loss():
    m, r = Model.new(8, 3), np.random.default_rng(3)
    x = r.integers(2, 20, (64, 20)).astype(np.uint8)
    y = np.zeros((64, 20), np.int64)
    y[x == 5] = 1
    before = gradients(m, x, y)[0]
    train(m, x, y, 30, batch=32, workers=2, tell=lambda s: None)
    assert gradients(m, x, y)[0] < before / 3


@pytest.fixture(scope="module")
def held_out():
    """Rows the model was not trained on, with their labelled spans of whole words."""
    texts, good, _ = train_pii.read("/root/testdata/sf0.01/split_record.parquet")
    return texts, good


def test_held_out_recall(held_out):
    """Against the delivered labels, whatever their form: all of whole words that others in the same surroundings do not contradict. A few of them are wrong."""
    texts, good = held_out
    near = train_pii.Surroundings(texts, good)
    found = pii.find(texts, Model.load(pii.MODEL))
    hit, all_ = dict.fromkeys(pii.KINDS, 0), dict.fromkeys(pii.KINDS, 0)
    for text, own, want in zip(texts, found, good, strict=True):
        for x in want:
            if x[2] and not near.contradicts(text, *x):
                all_[x[2]] += 1
                hit[x[2]] += x in own
    for kind, least in (("email", 0.98), ("phone", 0.98), ("id_number", 0.97), ("address", 0.97), ("name", 0.95)):
        assert all_[kind] > 250 and hit[kind] >= least * all_[kind], (kind, hit[kind], all_[kind])


def test_other_labels_are_left(held_out):
    """Orders, tickets, batches, cards, accounts, devices and the like: spans of other labels are no mentions."""
    texts, good = held_out
    near = train_pii.Surroundings(texts, good)
    found = pii.find(texts, Model.load(pii.MODEL))
    wrong = sum(1 for text, own, want in zip(texts, found, good, strict=True) for x in want if x[2] is None and not near.contradicts(text, *x) and x in own and not near.agrees(text, x[0], x[1], [y[2] for y in own if y == x][0]))
    assert wrong <= 5


@pytest.mark.parametrize(
    ("text", "values"),
    [("order reference 966-33-3834 replayed", []), ("ticket X12832682 reopened", []), ("ssn=966-33-3834 on file", ["966-33-3834"]), ("cb#+49 30 23125 914 lag=5", ["+49 30 23125 914"]), ("release Abrak Difmul rolled back", [])],
)
def test_surroundings_decide(text, values):
    around = "2031-03-10T11:32:17Z WARN mask-api[32973] A remote queue late rejected each throttled digest. "
    m = Model.load(pii.MODEL)
    text = around + text
    assert [text[a:b] for a, b, _ in pii.find([text], m)[0]] == values


def test_training_lesson():
    text = "order reference 966-33-3834, ssn=966-33-3834 and x@y.test"
    a = text.rindex("966")
    good, bad = train_pii.labelled(text, [{"span_start": a, "span_end": a + 11, "label": "ssn"}, {"span_start": 16, "span_end": 27, "label": "BUSINESS_ID"}, {"span_start": 17, "span_end": 27, "label": "SSN"}, {"span_start": None, "span_end": 3, "label": "SSN"}, {"span_start": 5, "span_end": 500, "label": "SSN"}])
    assert good == [(16, 27, None), (a, a + 11, "id_number")] and bad == [(17, 27, "id_number")]
    near = train_pii.Surroundings([text] * 30, [good] * 30)
    assert near.agrees(text, a, a + 11, "id_number") and near.contradicts(text, 16, 27, "id_number")
    own, others, doubt = train_pii.lesson(text, good, bad, [(a, a + 11, "id_number"), (48, 56, "email")], near)
    assert own == [(a, a + 11, "id_number")] and others == [(16, 27, None)] and doubt == [(17, 27, "id_number"), (48, 56, "email")]


def test_mentions_and_masks(spark):
    text = "2035 WARN x[1] reply to ab.cd@efg.test bounced; ssn=000-12-3927\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "  "), (1, "That idle schema merged the primary bucket. " * 200), (6, "x" * 9000), (5, "🙂 " + text)], "record_idx bigint, text string")
    got = {(r.record_idx, r.span_start, r.span_end, r.pii_kind) for r in pii.mentions(df.where("record_idx <> 6")).collect()}
    a, s = text.index("ab.cd"), text.index("000-")
    assert got == {(k, a + d, a + d + 14, "email") for k, d in ((1, 0), (5, 2))} | {(k, s + d, s + d + 11, "id_number") for k, d in ((1, 0), (5, 2))}
    labels = spark.createDataFrame([("email", "<EMAIL>"), ("id_number", "<ID_NUMBER>"), (None, None)], "pii_kind string, placeholder string")
    masked = sorted((r.record_idx, r.masked, r.replaced) for r in pii.mask(df, labels).where("record_idx in (2, 5)").collect())
    assert masked == [(2, None, 0), (5, "🙂 2035 WARN x[1] reply to <EMAIL> bounced; ssn=<ID_NUMBER>\n", 2)]
    assert pii.mentions(df.limit(0)).count() == 0
    assert all(0 <= r.span_start < r.span_end <= 9000 for r in pii.mentions(df.where("record_idx = 6")).collect())


def test_decode_does_not_cross_texts():
    m = Model.load(pii.MODEL)
    joined = Joined(["reply to ab@cd.test", "", "reply to ab@cd.test"])
    for a, b, _ in pii.decode(m, joined):
        assert not any(a < e < b for e in joined.ends.tolist())
