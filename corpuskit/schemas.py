"""Row types that the library reads and returns."""

from pyspark.sql import types as T

TEXT, TEXTS, META = T.StringType(), T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())
PAGE = T.StructType().add("url", TEXT).add("title", TEXT).add("text", TEXT).add("images", TEXTS).add("links", TEXTS).add("depth", T.IntegerType()).add("status_code", T.IntegerType())
DOCUMENT = T.StructType().add("id", TEXT).add("content", TEXT).add("embedding", T.ArrayType(T.FloatType())).add("metadata", META)
MATCH = T.StructType().add("id", TEXT).add("content", TEXT).add("metadata", META).add("score", T.DoubleType())
MESSAGE = T.StructType().add("role", TEXT).add("content", TEXT)
#: One chunk of each dialect of streamed responses.
GENERATE_CHUNK = "response string, message struct<role: string, content: string>, done boolean, total_duration bigint, load_duration bigint, prompt_eval_count bigint, prompt_eval_duration bigint, eval_count bigint, eval_duration bigint, context array<bigint>, done_reason string, model string, created_at string"
CHOICES_CHUNK = "choices array<struct<delta: struct<content: string>, finish_reason: string>>, model string, usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>"
EVENTS_CHUNK = "type string, delta struct<text: string>, usage struct<input_tokens: bigint, output_tokens: bigint>, model string, stop_reason string"
DOWNLOAD_CHUNK = "status string, digest string, total bigint, completed bigint"
