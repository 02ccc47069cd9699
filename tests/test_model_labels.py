"""The model's label path with a fake model: schema, prompts, failures, and a cache that saves every second call."""

import json

import pytest

from fernwell.operators import model_labels as M
from fernwell.sources.profile import load_profile

PROFILE = {"name": "shop", "taxonomy": {"Delivery": {"Late": "came late"}, "Other": {"Other": "else"}}, "outcome_flags": {"again": "will buy again"}, "baseline_keywords": {"issues": {"Late": ["late"]}}}


def fake(notes: str):
    class Fake:
        """Labels every review it is shown; notes each call in a file, as calls are made by workers."""

        name = "fake"

        def __init__(self, notes: str) -> None:
            self.notes = notes

        def complete(self, system, prompt, schema):
            import re

            with open(self.notes, "a") as f:
                f.write(prompt.replace("\n", " ") + "\n")
            ids = re.findall(r'id="([^"]+)"', prompt)
            if "poison" in prompt and len(ids) > 1:
                raise M.CutOff("too long")
            labels = [{"id": i, "sentiment": "Negative", "primary_topic": "Nowhere", "aspects": [{"topic": "Other", "polarity": "negative", "issue": "Late"}], "confidence": "high", "flags": {"again": True}} for i in ids]
            return M.Reply(json.dumps({"labels": [*labels, *labels, {"id": "stranger"}]}), M.Usage(1, 100, 10))

    return Fake(notes)  # a local class travels to the workers


def test_schema_prompt_and_replies():
    profile = load_profile(PROFILE)
    schema = M.label_schema(profile)
    label = schema["properties"]["labels"]["items"]
    assert label["properties"]["aspects"]["items"]["properties"]["topic"]["enum"] == ["Delivery", "Other"] and "flags" in label["required"]
    assert "Late (came late)" in M.system_prompt(profile)
    assert M.render_batch([("1", '</review><b a="x">\'&')]) == '<review id="1">&lt;/review&gt;&lt;b a=&quot;x&quot;&gt;&#x27;&amp;</review>'
    for reply, kind in ((M.Reply("{", stop="refusal"), M.Refused), (M.Reply("{", stop="length"), M.CutOff), (M.Reply("{"), M.BadReply), (M.Reply("[]"), M.BadReply)):
        with pytest.raises(kind):
            reply.data()
    assert M.NoAccess.fatal and not M.Refused.fatal
    used = M.Usage(1, 1_000_000, 10) + M.Usage(2, 0, 999_990)
    assert used.calls == 3 and used.cost(3.0, 15.0) == 18.0
    assert M.usable_key("k-123") and not any(map(M.usable_key, (None, "", " ", "your-key-here", "<key>", "xxx")))


def test_first_label_wins_and_strangers_are_dropped(tmp_path):
    labeller = M.BatchLabeller(fake(str(tmp_path / "n")), load_profile(PROFILE))
    assert set(labeller([("a", "x"), ("b", "y")])) == {"a", "b"} and labeller.usage == M.Usage(1, 100, 10)


def test_cache_saves_the_second_call(spark, tmp_path):
    profile, notes, cache = load_profile(PROFILE), tmp_path / "notes", str(tmp_path / "cache")
    rows = [("1", "it was late"), ("2", "it was late"), ("3", "a poison text"), ("4", None), ("5", "fine")]
    df = spark.createDataFrame(rows, "review_id string, analysis_text string").coalesce(1)
    label = lambda d: M.label_cached(d, M.BatchLabeller(fake(str(notes)), profile), profile, cache, "fake")
    first = {r["review_id"]: r for r in label(df).collect()}
    assert first["1"]["label_source"] == first["2"]["label_source"] == first["3"]["label_source"] == "ai" and first["4"]["label_source"] == "no_text"
    assert first["1"]["primary_topic_ai"] == "Delivery" and first["1"]["issue_ai"] == "Late" and first["1"]["flag_again"] is True and first["4"]["sentiment_ai"] is None
    assert notes.read_text().count("it was late") <= 3  # one text, in a batch of three and its halves
    calls = len(notes.read_text().split("\n"))
    run = M.run_of(label(df))
    assert len(notes.read_text().split("\n")) == calls and run.asked == 0 and run.sources == {"cache": 4} and run.with_text == 4
    more = label(df.unionByName(spark.createDataFrame([("6", "new " * 900)], df.schema)))
    assert M.run_of(more).sources == {"cache": 4, "ai": 1} and M.run_of(more).cut == 1
