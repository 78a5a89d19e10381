"""Fixed values shared by the operators."""

# Special token ids of the derived vocabulary.
UNK_ID = -1
PAD_ID = -2
CLS_ID = -3
SEP_ID = -4
MASK_ID = -5

# Label value that a loss ignores.
IGNORED_LABEL = -100

# Special tokens placed first in a word-piece vocabulary, in this order.
WORDPIECE_SPECIALS = ["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"]

# Special token placed first in a byte-pair vocabulary.
BPE_SPECIALS = ["<|endoftext|>"]

# Languages of the code corpus.
CODE_LANGUAGES = ["python", "java", "javascript", "go", "ruby", "php"]

# Marker for a space kept in front of a token.
SPACE_MARK = "Ġ"

# Continuation prefix of word pieces.
CONTINUATION = "##"

# Decimals that similarity scores are rounded to before ranking, so that a
# ranking does not depend on the order in which floating sums were formed.
SCORE_DECIMALS = 6
