"""quillspark: text tokenization analytics on Spark DataFrames."""

from quillspark.functions.codechunks import chunks as code_chunks
from quillspark.functions.codechunks import hybrid_chunks as hybrid_code_chunks
from quillspark.functions.normalize import NormalizerConfig
from quillspark.model import Model, SpecialTokens, model_hash, model_info
from quillspark.operators.encode import Encoder, decode, encode, explain_function, register
from quillspark.operators.training import train_bpe, train_bpe_fast, train_fair_bpe

__version__ = "0.1.0"
__all__ = ["Encoder", "Model", "NormalizerConfig", "SpecialTokens", "__version__", "code_chunks", "decode", "encode", "explain_function", "hybrid_code_chunks", "model_hash", "model_info", "register", "train_bpe", "train_bpe_fast", "train_fair_bpe"]
