"""Explicit schemas of the files that runs are made of; inference is never relied on."""

from __future__ import annotations

DOCUMENT = "struct<title:string,body:string>"
QA_FIELDS = (
    "question string, reference_answer string, raw_reference_answer string, aliases array<string>, id string, "
    f"source_documents array<{DOCUMENT}>, source_language string, target_language string"
)
PROMPTS = f"prompt_id bigint, dataset string, prompt_text string, {QA_FIELDS}"
FINAL = "struct<is_correct:boolean,correctness_method:string,answer:string,response:string>"
ANSWERS = (
    f"{QA_FIELDS}, qa_index int, response_sample_id int, num_response_samples int, qa_example_id string, "
    "sample_example_id string, generation_mode string, example_id string, sample_id int, dataset string, prompt string, "
    f"raw_answer string, parsed_answer string, label boolean, final {FINAL}"
)
TENSOR = "run string, sample_id int, pos int, rank int, token_id int, logprob float"
TRAJECTORIES = "prompt_id string, num_steps int, response_sample_id int, step_answers array<string>, final_answer string"
FEATURES = "prompt_id string, is_correct boolean, n_visible_tokens int, " + ", ".join(f"`{f}` double" for f in ("msp", "perplexity", "mte", "mcnse", "se-marginal", "se-conditional", "ecc", "eigval", "kle-heat", "kle-matern"))
LATENCY = "run_id string, model_id string, dataset string, family string, feature string, n_prompts int, n_extra_gen int, n_nli_pairs int, " + ", ".join(
    f"{c} double" for c in ("time_gen_mean", "time_gen_std", "time_nli_mean", "time_nli_std", "time_math_mean", "time_math_std", "time_total_mean", "time_total_std", "overhead_mean", "overhead_std")
)

# Raw rows of each dataset.
RAW = {
    "gsm8k": "question string, answer string",
    "triviaqa": "question string, question_id string, answer struct<value:string,aliases:array<string>>",
    "wmt14_fr_en": "translation struct<fr:string,en:string>",
    "xsum": "document string, summary string, id string",
    "samsum": "dialogue string, summary string, id string",
    "hotpotqa": "question string, answer string, id string, context struct<title:array<string>,sentences:array<array<string>>>",
    "musique": "question string, answer string, id string, answer_aliases array<string>, paragraphs array<struct<title:string,paragraph_text:string>>",
}
