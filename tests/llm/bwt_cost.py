"""What merging Burrows-Wheeler transforms costs on this machine: nanoseconds a byte, on one core.

    python tests/llm/bwt_cost.py [documents.parquet] [bytes of a shard]

Sorts the suffixes of two shards by prefix doubling, then merges their transforms by interleave
refinement: each round re-sorts a bit vector stably by the shards' transforms, and after k rounds the
interleave is right for prefixes of k bytes.
"""

import sys
import time

import numpy as np
import pyarrow.parquet as pq


def suffix_order(b: np.ndarray) -> np.ndarray:
    rank, width = b.astype(np.int64), 1
    while True:
        after = np.r_[rank[width:] + 1, np.zeros(min(width, len(b)), np.int64)]
        order = np.argsort(rank * (rank.max() + 2) + after, kind="stable")
        key = (rank * (rank.max() + 2) + after)[order]
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        if rank.max() == len(b) - 1:
            return order
        width *= 2


def refine(z: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One round: the interleave's next bits, from the symbols that precede its current rows."""
    symbols = np.empty(len(z), np.uint8)
    symbols[z == 0], symbols[z == 1] = first, second
    return z[np.argsort(symbols, kind="stable")]


def main() -> None:
    path = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1/documents.parquet"
    size = int(sys.argv[2]) if len(sys.argv) > 2 else 1 << 21
    data = "".join(t or "" for t in pq.read_table(path, columns=["text"]).column(0).to_pylist()).encode()
    shards = [np.frombuffer(data[i * size : (i + 1) * size], np.uint8) for i in range(2)]
    began = time.process_time()
    orders = [suffix_order(s) for s in shards]
    sort = (time.process_time() - began) / sum(map(len, shards)) * 1e9
    transforms = [s[o - 1] for s, o in zip(shards, orders)]
    z = np.r_[np.zeros(len(shards[0]), np.int8), np.ones(len(shards[1]), np.int8)]
    began, rounds = time.process_time(), 8
    for _ in range(rounds):
        z = refine(z, *transforms)
    step = (time.process_time() - began) / rounds / len(z) * 1e9
    print(f"suffix sort {sort:.0f} ns a byte; a round of refinement {step:.1f} ns a byte, 200 rounds {200 * step:.0f} ns a byte")


if __name__ == "__main__":
    main()
