"""What an aligner holds is small: ids of four bytes, and texts in groups of at most half a MiB."""

import public_tokenizers
import pyarrow as pa

from loomgrain.llm import align


def test_remembered_ids_have_four_bytes():
    own = align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    own.align(pa.array(["some words here", "", "other words"]))
    assert [f.dtype.itemsize for f in own.flat] == [4, 4] and all(len(f) for f in own.flat)
    assert align.GROUP_BYTES <= 1 << 19
