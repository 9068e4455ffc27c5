"""Arriving files are processed once; failures stay with their file."""

import json

from orderlark.sources import files
from orderlark.streaming import stages


def drop(folder, name, calls):
    (folder / name).write_text("\n".join(json.dumps({"filepath": p, "answer": a}) for p, a in calls), encoding="utf-8")


def run(spark, inbox, tmp_path):
    query = stages.process_arrivals(stages.arriving_answers(spark, str(inbox)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    return stages.read_events(spark, str(tmp_path / "out"))


def test_process_once_and_restart(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    good = '{"dialogue": [{"speaker": "customer", "text": "t", "emotion": "Sad"}], "summary": "s"}'
    drop(inbox, "1.json", [("/x/a.wav", good), ("/x/b.txt", good), ("/x/c.mp3", "")])
    events = run(spark, inbox, tmp_path)
    assert {r["filename"]: r["count"] for r in events.groupBy("filename").count().collect()} == {"a.wav": 8, "c.mp3": 3}
    drop(inbox, "2.json", [("/x/d.flac", "not json")])
    events = run(spark, inbox, tmp_path)
    assert {r["filename"]: r["count"] for r in events.groupBy("filename").count().collect()} == {"a.wav": 8, "c.mp3": 3, "d.flac": 8}
    failed = events.where("filename = 'd.flac' AND stage = 'emotion_analysis'").first()
    assert failed["result"] == "Analysis failed."
    sentence = events.where("filename = 'a.wav' AND stage = 'emotion_analysis'").first()["result"]
    assert sentence == "Customer emotion trend: Sad. The customer's emotion was Sad."
    assert events.where("type = 'processing_error'").first()["filename"] == "c.mp3"

    latest = stages.track_latest(spark, str(tmp_path / "out"), str(tmp_path / "latest"), str(tmp_path / "latest-state"))
    latest.awaitTermination()
    streamed = {r["filename"]: r["type"] for r in stages.read_latest(spark, str(tmp_path / "latest")).collect()}
    batch = {r["filename"]: r["type"] for r in stages.latest_stage(events).collect()}
    assert streamed == batch == {"a.wav": "processing_completed", "c.mp3": "processing_error", "d.flac": "processing_completed"}


def test_transcripts_meet_recordings(spark, tmp_path):
    (tmp_path / "t" / "deep").mkdir(parents=True)
    (tmp_path / "w").mkdir()
    (tmp_path / "t" / "a.txt").write_text("[1s] x\n[2s] y", encoding="utf-8")
    (tmp_path / "t" / "deep" / "b.txt").write_text("[1s] z", encoding="utf-8")
    (tmp_path / "w" / "a.wav").write_bytes(b"1234")
    texts = files.transcript_files(spark, str(tmp_path / "t"))
    recordings = files.list_files(spark, str(tmp_path / "w"), "*.wav")
    assert [(r["key"], r["length"]) for r in recordings.collect()] == [("a", 4)]
    assert [(r["key"], r["content"]) for r in files.with_recording(texts, recordings).collect()] == [("a", "[1s] x\n[2s] y")]
    assert [r["key"] for r in files.without_recording(texts, recordings).collect()] == ["b"]
