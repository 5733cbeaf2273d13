import json

from corpuskit.cli import main
from corpuskit.operators.provider import EchoProvider, lines_until, message_content
from corpuskit.streaming import responses as R


def chunks(spark, name, *rows):
    return R.parsed(spark.createDataFrame([("s", i, json.dumps(r)) for i, r in enumerate(rows)] + [("s", 99, "")], "stream_id string, seq bigint, value string"), name)


def test_generate(spark):
    # two final chunks: the last one's numbers count; a chunk without text between
    rows = [{"response": "Tide "}, {"response": None}, {"response": "tables", "done": True, "eval_count": 3}, {"message": {"role": "x"}, "response": "unheard"}, {"response": ".", "done": True, "total_duration": 1_500_000_000, "eval_duration": 800_000_000, "eval_count": 14}]
    r = R.Replay(chunks(spark, "generate", *rows), "generate")
    assert r.full_response("s") == r.full_response("s") == "Tide tables." and r.full_response("t") == ""
    assert r.stats().first()[1:] == (1.5, 0.8, 14, 17.5) and r.metadata("s")["eval_count"] == 14


def test_order_is_that_of_the_numbers_not_of_arrival(spark):
    lines = [("s", 7, '{"response": "c"}'), ("t", 1, '{"response": "z"}'), ("s", 2, '{"response": "a"}'), ("s", 5, '{"response": "b"}')]
    got = R.fold(R.parsed(spark.createDataFrame(lines, "stream_id string, seq bigint, value string"), "generate"), "generate")
    assert {r.stream_id: (r.text, r.chunks, r.done) for r in got.collect()} == {"s": ("abc", 3, False), "t": ("z", 1, False)}


def test_choices_and_events(spark):
    c = chunks(spark, "choices", {"choices": []}, {"choices": [{"delta": {"content": "ebb"}}]}, {"choices": [{"delta": {"content": None}}]}, {"choices": [{"delta": {"content": "/flow"}, "finish_reason": "length"}], "usage": {"prompt_tokens": 4, "completion_tokens": 9, "total_tokens": 13}})
    f = R.fold(c, "choices")
    assert f.first().text == "ebb/flow" and f.first().metadata.finish_reason == "length" and R.usage_stats(f, "choices").first()[1:] == (4, 9, 13)
    c = chunks(spark, "events", {"type": "content_block_delta", "delta": {"text": "neap"}}, {"type": "other", "delta": {"text": "unheard"}}, {"type": "content_block_delta", "delta": {}}, {"type": "message_stop", "stop_reason": "limit", "usage": {"input_tokens": 2, "output_tokens": None}})
    f = R.fold(c, "events")
    assert f.first().text == "neap" and f.first().metadata.stop_reason == "limit" and R.usage_stats(f, "events").first()[1:] == (2, 0)


def test_download(spark):
    c = chunks(spark, "download", {"status": "asking"}, {"status": "layer", "digest": "y", "total": 4_194_304, "completed": 0}, {"status": "layer", "total": 4_194_304, "completed": 3_145_728}, {"status": "layer", "total": 0, "completed": 2_097_152})
    assert R.download_stats(c).first().asDict() == {"stream_id": "s", "status": "layer", "total": 4_194_304, "completed": 2_097_152, "updates": 3, "mb": 2.0, "percentage": 50.0}
    assert [(r.total, r.percentage) for r in R.download_progress(c).orderBy("seq").collect()] == [(0, None), (4_194_304, 0.0), (4_194_304, 75.0), (4_194_304, 0.0)]


def test_bodies_and_lines():
    body = '{"message":{"content":" spring tide "}}'
    assert message_content(body) == "spring tide" and message_content(body * 2) == "" and message_content('{"done":true}') == "" and message_content("") == ""
    got = list(lines_until(iter([b'{"n":1}', b"", b'{"n":2,"end":1}', b'{"n":3}']), lambda c: c.get("end")))
    assert [x["n"] for x in got] == [1, 2]
    e = EchoProvider()
    assert e.name == "echo" and e.generate("ebb and flow") == "ebb and flow" and "".join(c["response"] for c in e.chat([{"role": "user", "content": "ebb and"}], True)) == "ebb and"


def test_cli(capsys):
    assert main(["--version"]) == main(["show-version"]) == main(["serve"]) == 0
    assert capsys.readouterr().out.count("corpuskit") == 2
