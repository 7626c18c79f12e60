"""BagMinHash signatures of shingle multisets.

A shingle of weight w owns the unit slots 0 .. w-1. Every slot is a Poisson process over the registers; a register
keeps the earliest point that any slot of the document sends it, so two registers agree with the probability of
the weighted Jaccard similarity. Slots are grouped into dyadic intervals [0,1), [1,2), [2,4), [4,8) ...: the
process of an interval is generated as one, at the rate of its length, and a point of it counts if the slot it
falls on is below w. A weight so costs the logarithm of itself. Points come in order of time, and an interval is
left when its next point is later than the time by which every register is filled.
"""

from __future__ import annotations

import numpy as np

from . import text

REGISTERS = 128
ROWS = 4  # registers of a band
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOT = np.uint64(0xD1B54A32D192ED03)


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """(n_docs, registers) unsigned: the bits of the earliest times. Rows of documents without shingles mean nothing."""
    total = np.bincount(doc, weight, n_docs)
    units = [(np.arange(len(doc)), np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64))]
    low = 1
    while len(at := np.flatnonzero(weight > low)):
        units.append((at, np.full(len(at), low), np.full(len(at), low)))
        low *= 2
    at, lows, lengths = (np.concatenate(x) for x in zip(*units, strict=True))
    of, top = doc[at], weight[at]
    state = text.mix(shingle[at] + lows.astype(np.uint64) * _SLOT)
    rate = (lengths * registers).astype(float)
    limit = (np.log(registers) + 3.0) / np.maximum(total, 1)
    time, turn = np.zeros(len(at)), np.zeros(len(at), np.uint64)
    out = np.full(n_docs * registers, np.inf)

    def draw(which: np.ndarray) -> np.ndarray:
        turn[which] += np.uint64(1)
        drawn = text.mix(state[which] + turn[which] * _STEP)
        time[which] -= np.log(((drawn >> np.uint64(11)).astype(float) + 1.0) * 2.0**-53) / rate[which]
        return drawn

    drawn = draw(np.arange(len(at)))
    live = np.arange(len(at))
    while True:
        early = time[live] < limit[of[live]]
        which, bits = live[early], drawn[live][early]
        if not len(which):
            unfilled = np.isinf(out.reshape(n_docs, registers)).any(axis=1) & (total > 0)
            if not unfilled.any():
                break
            limit[unfilled] *= 2
            live = np.flatnonzero(unfilled[of])
            continue
        slot = (text.mix(bits ^ _SLOT) & (lengths[which] - 1).astype(np.uint64)).astype(np.int64) + lows[which]
        counts = slot < top[which]
        to = of[which] * registers + (bits & np.uint64(registers - 1)).astype(np.int64)
        np.minimum.at(out, to[counts], time[which][counts])
        drawn[which] = draw(which)
        live = which
    return out.reshape(n_docs, registers).view(np.uint64)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n_docs, bands) keys: equal where all ``rows`` registers of the band are."""
    parts = signature.reshape(len(signature), -1, rows)
    key = np.arange(parts.shape[1], dtype=np.uint64)[None, :] * _SLOT
    for k in range(rows):
        key = text.mix(key + parts[:, :, k])
    return key
