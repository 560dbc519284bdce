import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from linewright.llm.tokens import BatchEncoder


def test_letters_that_change_with_case_or_marks_encode_as_the_library():
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [
        "MİLLİ, İ. Aİ, İİ", "J̌ T̈ H̱ ǰ, ǨA.", "ÀÉ, é. É. ẞ, ΑΣ, ǅ.",
        "İstanbul'da, xİa.", "Hello, WORLD. A.B,",
    ]
    r = random.Random(3)
    letters = "aAJTHbİıÉßΣ̱̌̈̇.,'9é"
    texts += [" ".join("".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(40)) for _ in range(200)]
    encoder = BatchEncoder()
    offsets, ids = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        want = plain.encode(text, add_special_tokens=False).ids
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want, text
