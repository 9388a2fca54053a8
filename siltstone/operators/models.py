"""Models behind the generator protocol: a causal language model of the transformers library, and single-shot inference.

torch and transformers are imported when a worker makes its model, so that everything else works without them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators import prompts
from siltstone.operators.generate import Generator, generated

QUANTIZATIONS = ("8bit", "4bit", "none")
INFERENCE = {"max_length": 1024, "temperature": 0.2, "top_p": 0.9, "top_k": 50}


def load_options(quantization: str = "8bit", cuda: bool = True) -> dict:
    """What the model is loaded with. Quantized weights need a GPU; without one the weights are whole."""
    if quantization not in QUANTIZATIONS:
        raise ValueError(f"unknown quantization {quantization}")
    if not cuda:
        return {"torch_dtype": "float32"}
    out = {"device_map": "auto", "torch_dtype": "bfloat16"}
    return out if quantization == "none" else out | {"quantization_config": {f"load_in_{quantization}": True}}


class CausalModel:
    """Left-padded batches; sampling if the temperature is above 0, each batch from the seed of its first row."""

    def __init__(self, path: str, quantization: str = "8bit", token: str | None = None):
        import torch
        import transformers

        self.torch = torch
        self.cuda = torch.cuda.is_available()
        options = load_options(quantization, self.cuda)
        options["torch_dtype"] = getattr(torch, options["torch_dtype"])
        if "quantization_config" in options:
            options["quantization_config"] = transformers.BitsAndBytesConfig(**options["quantization_config"])
        self.tokenizer = transformers.AutoTokenizer.from_pretrained(path, padding_side="left", token=token)
        if self.tokenizer.pad_token is None:
            self.tokenizer.pad_token = self.tokenizer.eos_token
        self.model = transformers.AutoModelForCausalLM.from_pretrained(path, token=token, **options)

    def generate(self, prompts: list[str], seeds: list[int], **options) -> list[str]:
        self.torch.manual_seed(seeds[0] % 2**63 if seeds else 0)
        inputs = self.tokenizer(prompts, return_tensors="pt", padding=True, truncation=True)
        if self.cuda:
            inputs = {k: v.to("cuda") for k, v in inputs.items()}
        with self.torch.no_grad():
            out = self.model.generate(**inputs, do_sample=options.get("temperature", 0) > 0, pad_token_id=self.tokenizer.eos_token_id, **options)
        return self.tokenizer.batch_decode(out, skip_special_tokens=True)


def causal(path: str, quantization: str = "8bit", token: str | None = None) -> Callable[[], Generator]:
    """For generated(): makes the model in each worker."""
    if quantization not in QUANTIZATIONS:
        raise ValueError(f"unknown quantization {quantization}")
    return lambda: CausalModel(path, quantization, token)


def inferred(rows: DataFrame, make: Callable[[], Generator], **options) -> DataFrame:
    """Adds response: what a model answers to each row's instruction between its response tags, one row at a time."""
    asked = rows.withColumn("prompt", prompts.inference(F.col("instruction")))
    answered = generated(asked, make, batch_size=1, defaults=INFERENCE, **options)
    return answered.withColumn("response", text.tagged_response(F.col("output"))).drop("prompt", "output")
