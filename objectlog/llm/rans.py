"""Static range asymmetric numeral system over token ids: interleaved blocks with checkpoints and a checksum.

A block is coded by LANES interleaved 64-bit states: token i belongs to lane i % LANES, and a row is one token of each
lane. States put out 32-bit words into one stream. Every ROWS rows the encoder notes all states and the place in the
stream, so a reader may start there; `decode` runs all these stretches of a block side by side.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 512
ROWS = 128
LOW = 31  # a state is at least 2**LOW between tokens


class Table:
    """Frequencies scaled to a power of two, at least one for each id that occurs."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, bits: int | None = None):
        size = int(ids.max()) + 1 if len(ids) else 1
        self.bits = bits or max(12, size.bit_length() + 2)
        whole = 1 << self.bits
        scaled = np.zeros(size, np.int64)
        if len(ids):
            scaled[ids] = np.maximum(1, counts * (whole / counts.sum())).astype(np.int64)
            over = int(scaled.sum()) - whole
            for at in np.argsort(-scaled, kind="stable"):  # the largest take what rounding left
                new = max(1, int(scaled[at]) - over)
                over -= int(scaled[at]) - new
                scaled[at] = new
                if not over:
                    break
        self.freq = scaled.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(scaled)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), scaled)


def encode(ids: np.ndarray, table: Table) -> dict:
    """Words, checkpoints (row-wise states and stream places) and checksum of one block of ids."""
    shift, low = np.uint64(table.bits), np.uint64(LOW)
    rows = -(-len(ids) // LANES)
    states = np.full(LANES, 1 << LOW, np.uint64)
    chunks: list[np.ndarray] = [np.zeros(0, np.uint32)] * rows
    marks: list[np.ndarray] = []
    room = np.uint64(LOW - table.bits + 32)
    for r in range(rows - 1, -1, -1):
        part = ids[r * LANES : (r + 1) * LANES]
        f, c = table.freq[part], table.first[part]
        x = states[: len(part)]
        over = x >= (f << room)
        chunks[r] = x[over].astype(np.uint32)
        x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        states[: len(part)] = (q << shift) + (x - q * f) + c
        if r % ROWS == 0:
            marks.append(states.copy())
    words = np.concatenate([np.zeros(0, np.uint32), *chunks]).astype("<u4").tobytes()
    places = np.concatenate([[0], np.cumsum([len(c) for c in chunks])])[:-1:ROWS] if rows else np.zeros(0)
    saved = np.array(marks[::-1], "<u8").tobytes()
    return {
        "n": len(ids), "places": places.astype(int).tolist(), "states": saved, "words": words,
        "crc": zlib.crc32(words, zlib.crc32(saved)),
    }


def decode(block: dict, table: Table, part: int | None = None) -> np.ndarray:
    """The ids of a block, or of its stretch `part` (LANES * ROWS ids) alone. Raises ValueError on a wrong checksum."""
    if zlib.crc32(block["words"], zlib.crc32(block["states"])) != block["crc"]:
        raise ValueError("damaged block")
    n = block["n"]
    if not n:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
    states = np.frombuffer(block["states"], "<u8").reshape(-1, LANES).astype(np.uint64)
    at = np.array(block["places"], np.int64)
    stretches = np.arange(len(at))
    if part is not None:
        states, at, stretches = states[part : part + 1].copy(), at[part : part + 1], stretches[part : part + 1]
    shift, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    out = np.zeros((len(at), ROWS, LANES), np.uint32)
    rows = -(-n // LANES)
    for r in range(min(ROWS, rows)):
        slot = states & mask
        s = table.symbol[slot.view(np.int64)]
        x = table.freq[s] * (states >> shift) + slot - table.first[s]
        need = x < np.uint64(1 << LOW)
        last = rows - 1 - r  # ROWS times the stretch that ends in this row, if one does
        for k in np.flatnonzero(stretches * ROWS >= last):  # lanes without a token stay as they are
            live = n - (rows - 1) * LANES if stretches[k] * ROWS == last else 0
            x[k, live:] = states[k, live:]
            need[k, live:] = False
        taken = need.sum(axis=1)
        places = np.repeat(at - np.cumsum(taken) + taken, taken) + np.arange(taken.sum())
        x[need] = (x[need] << np.uint64(32)) | words[places]
        states = x
        at = at + taken
        out[:, r, :] = s
    flat = out.reshape(-1)
    whole = n if part is None else min(n - part * ROWS * LANES, ROWS * LANES)
    return flat[:whole]
