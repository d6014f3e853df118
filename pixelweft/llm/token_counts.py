"""Edit-aware token counts.

A document keeps a segment tree over its pre-token blocks: leaves are stretches of about `leaf_chars` characters that
end with a blank, and every node has the characters and the tokens below it. An edit goes down the tree to the leaves
it touches, re-encodes only those (with the leaf that follows, if the blank between them goes), and updates the sums on
the way up. The vocabularies here have no token across a blank (see `tokens`), so the root equals the count of the whole
new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import WordEncoder, encoder

BLANK = " "


class SegmentTree:
    """Characters and tokens of the blocks of one text; nodes 1 .. 2*size-1, leaves from `size` on."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = len(chars) // 2
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of_all(cls, texts: list[str], enc: WordEncoder, leaf_chars: int = 400) -> list[SegmentTree]:
        cut = []
        for text in texts:
            # where tokens may cross blanks, one leaf is encoded whole
            step, blocks, at = leaf_chars if enc.by_word else len(text) + 1, [], 0
            while at < len(text):
                end = text.find(BLANK, at + step) + 1 or len(text)
                blocks.append(text[at:end])
                at = end
            cut.append(blocks)
        counts, trees = iter(enc.counts([b for blocks in cut for b in blocks])), []
        for blocks in cut:
            size = 1 << max(0, len(blocks) - 1).bit_length()
            empty = [0] * (size - len(blocks))
            tree = cls([0] * size + [len(b) for b in blocks] + empty, [0] * size + [next(counts) for _ in blocks] + empty)
            for node in range(size - 1, 0, -1):
                tree._sum(node)
            trees.append(tree)
        return trees

    @classmethod
    def of(cls, text: str, enc: WordEncoder, leaf_chars: int = 400) -> SegmentTree:
        return cls.of_all([text], enc, leaf_chars)[0]

    def _sum(self, node: int) -> None:
        for values in (self.chars, self.tokens):
            values[node] = values[2 * node] + values[2 * node + 1]

    def count(self) -> int:
        return self.tokens[1]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds character `place`, or the last one with characters, and where it starts."""
        node, start = 1, 0
        place = max(0, min(place, self.chars[1] - 1))
        while node < self.size:
            node *= 2
            if place >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node, start

    def edit(self, text: str, start: int, stop: int, replacement: str, enc: WordEncoder) -> tuple[str, int]:
        """text[start:stop] becomes replacement: the new text, and how many characters were encoded for it."""
        start = max(0, min(start, len(text)))
        stop = max(start, min(stop, len(text)))
        first, begin = self.leaf_at(start)
        last, at = self.leaf_at(max(start, stop - 1))
        end = at + self.chars[last]
        region = text[begin:start] + replacement + text[stop:end]
        while end < len(text) and region and not region.endswith(BLANK):
            last, at = self.leaf_at(end)
            end += self.chars[last]
            region += text[at:end]
        for leaf in range(first, last + 1):
            self.chars[leaf] = self.tokens[leaf] = 0
        self.chars[first], self.tokens[first] = len(region), enc.count(region)
        low, high = first // 2, last // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2
        return text[:start] + replacement + text[stop:], len(region)


def build_trees(docs: DataFrame, vocabulary: str, leaf_chars: int = 400) -> DataFrame:
    """doc_id, text (null: empty), n_tokens, tree_chars, tree_tokens of every whole text; repeated rows stay repeated."""
    def build(batches):
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            trees = SegmentTree.of_all(texts, enc, leaf_chars)
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array([t.count() for t in trees], pa.int64()),
                 pa.array([t.chars for t in trees], ints), pa.array([t.tokens for t in trees], ints)],
                ["doc_id", "text", "n_tokens", "tree_chars", "tree_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        build, "doc_id long, text string, n_tokens long, tree_chars array<int>, tree_tokens array<int>")


EDIT = "struct<start:int,stop:int,replacement:string>"


def apply_edits(trees: DataFrame, edits: Column, vocabulary: str, keep_text: bool = False) -> DataFrame:
    """Apply to each row of build_trees its edits, an array of (start, stop, replacement) in code points, in turn.

    Places refer to the text as the edits before left it and are brought within it; a null array is no edit, a null
    replacement is empty. Returns doc_id, n_tokens (before), edited_n_tokens, edited_n_chars, reencoded_chars, n_leaves and,
    with keep_text, edited_text and the updated tree, so that later edits can go on from there.
    """
    def apply(batches):
        import pyarrow as pa

        enc = encoder(vocabulary)
        for batch in slices(batches):
            rows = []
            for doc, text, n, chars, tokens, todo in zip(*(c.to_pylist() for c in batch.columns)):
                tree, done = SegmentTree(chars, tokens), 0
                leaves = sum(1 for c in chars[tree.size:] if c)
                for e in todo or ():
                    text, k = tree.edit(text, e["start"] or 0, e["stop"] or 0, e["replacement"] or "", enc)
                    done += k
                rows.append((doc, n, tree.count(), len(text), done, leaves, text, tree.chars, tree.tokens)[: 9 if keep_text else 6])
            ints = pa.list_(pa.int32())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), ints, ints]
            names = ["doc_id", "n_tokens", "edited_n_tokens", "edited_n_chars", "reencoded_chars", "n_leaves", "edited_text", "tree_chars", "tree_tokens"]
            columns = list(zip(*rows)) or [()] * (9 if keep_text else 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names[: len(columns)])

    schema = "doc_id long, n_tokens long, edited_n_tokens long, edited_n_chars long, reencoded_chars long, n_leaves int"
    return trees.select("doc_id", "text", "n_tokens", "tree_chars", "tree_tokens", edits.cast(f"array<{EDIT}>").alias("edits")).mapInArrow(
        apply, schema + (", edited_text string, tree_chars array<int>, tree_tokens array<int>" if keep_text else ""))
