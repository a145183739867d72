"""Operators 1, 2, 3 and 9: per-text results against libraries and brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sedimenta.llm import audio, bpe, language_id, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD_TEXT = st.text(alphabet=st.sampled_from(list("ab 'sStlvremd\n\t  é漢字1२!?<|>endoftext\U0001f600՘\x1c\x85ẞ")), max_size=60)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(ODD_TEXT)
def test_encoding_is_the_librarys(text):
    b = bpe.load(PATH)
    ids = b.encode(text)
    assert np.frombuffer(ids, dtype="<u4").tolist() == ids_of(text)
    assert b.decode(ids).decode("utf-8", "replace") == LIBRARY.decode(ids_of(text), skip_special_tokens=False) == text


def test_every_token_encodes_to_itself():
    b = bpe.load(PATH)
    b_ids, b.ids = b.ids, {}  # without the short cut for whole tokens
    try:
        assert all(b.encode_piece(t) == [i] for t, i in list(b_ids.items())[::37])
    finally:
        b.ids = b_ids


def test_a_workers_memory_is_bounded():
    made = []
    memory = bpe.Memory(lambda key: made.append(key) or b"x" * 100)
    for n in range(3 * bpe.MEMORY // (bpe.ENTRY + 100)):
        memory[str(n)]
    assert max(len(memory) * (bpe.ENTRY + 100), memory.held) <= bpe.MEMORY + 1000
    long = "y" * 10_000
    assert memory[long] and long not in memory
    memory.forget()
    assert not memory and memory.held == 0


def test_a_worker_gives_its_tables_back():
    import weakref

    b = bpe.load(PATH)
    assert b.encode("some text") and "library" not in bpe.Bpe(PATH).__dict__
    gone = weakref.ref(b)
    del b
    bpe.unload()
    assert gone() is None and bpe.load.cache_info().currsize == 0


def test_stable_characters_are_split_as_the_library_splits():
    for text in ("x" * 30_000, " " * 5000 + "x", "ab" * 20_000, "\n \n" * 1000):
        assert np.frombuffer(bpe.load(PATH).encode(text), dtype="<u4").tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(ODD_TEXT)
def test_prefix_counts_are_the_librarys_for_every_prefix(text):
    counter = token_counts.PrefixCounter(bpe.load(PATH))
    counts = np.cumsum(counter.text(text), dtype=np.int64).tolist()
    assert counts == [len(ids_of(text[:i])) for i in range(1, len(text) + 1)]


def test_edges_of_encoding(edge_docs, no_docs, edge_texts):
    got = bpe.encode_decode(edge_docs, PATH).collect()
    assert len(got) == len(edge_texts) + 1
    for r in got:
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids_of(edge_texts[r.doc_id])
        assert r.decoded == (edge_texts[r.doc_id] or "")
    assert bpe.encode_decode(no_docs, PATH).collect() == []


def test_edges_of_counts_and_questions(edge_docs, no_docs, edge_texts):
    stored = token_counts.count_tokens(edge_docs, PATH).cache()
    assert sorted((r.doc_id, r.n_tokens) for r in stored.collect()) == sorted((i, len(ids_of(edge_texts[i]))) for i in [*edge_texts, 5])
    for r in token_counts.tokens_within(stored, F.lit(9)).collect():
        assert r.n_tokens == len(ids_of((edge_texts[r.doc_id] or "")[:9]))
    for r in token_counts.chars_within(stored, F.lit(7)).collect():
        text = edge_texts[r.doc_id] or ""
        assert r.n_chars == max((n for n in range(min(len(text), 200) + 1) if len(ids_of(text[:n])) <= 7), default=0)
    assert token_counts.count_tokens(no_docs, PATH).collect() == []


def test_a_wide_table_keeps_its_counts():
    counter = token_counts.PrefixCounter(bpe.load(PATH))
    counter.chunk = lambda text: [0, 300, 1]
    assert counter.plain("ab").tolist() == [300, -299]


def test_op2_and_op9_over_the_table(spark, sf, docs_001):
    for r in token_counts.op2_token_counts(spark, sf).collect():
        n = len(ids_of(docs_001[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs_001[r.doc_id].encode()), n, n > 512)
    for r in bpe.op9_bpe(spark, sf).collect():
        ids = ids_of(docs_001[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs_001[r.doc_id].encode()).hexdigest()


def test_op1_over_the_table(spark, sf, docs_001):
    rows = audio.op1_audio_features(spark, sf).collect()
    assert len(rows) == len(docs_001)
    by_text = {}
    for r in rows:
        data = docs_001[r.doc_id].encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        wav = b"RIFF" + (36 + len(payload)).to_bytes(4, "little") + b"WAVEfmt " + bytes.fromhex("10000000010001008" "03e0000803e000001000800") + b"data" + len(payload).to_bytes(4, "little") + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest())
        assert by_text.setdefault(data, r.feature) == r.feature


def test_audio_features_of_a_tone(spark):
    rate, t = 16000, np.arange(32000) / 16000
    x = np.where((t > 0.5) & (t < 1.5), np.sin(2 * np.pi * 1000 * t), 0) * 100 + 128
    clip = spark.createDataFrame([(1, bytearray(x.astype(np.uint8).tobytes()))], "id long, raw binary").select("id", audio.wav(F.col("raw"), rate).alias("media"))
    r = audio.audio_features(clip, "id").first()
    assert len(r.segments) == 1
    assert r.segments[0].start_s == pytest.approx(0.5, abs=0.05)
    assert r.segments[0].end_s == pytest.approx(1.5, abs=0.05)
    chunks = audio.read_tensors(r.tensors)
    mel = chunks.column("log_mel").chunk(0).to_numpy_ndarray()
    assert mel.shape[1:] == (audio.FRAMES, audio.MELS)
    loud = mel.reshape(-1, audio.MELS)[60].argmax()
    assert abs(audio.mel_bank(10000)[:, loud].argmax() * 10000 / audio.FFT - 1000) < 100
    assert chunks.column("n_frames").to_pylist()[-1] <= audio.FRAMES


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (5, 8), (160, 441), (3, 2), (7, 1)])
def test_resampling_keeps_a_low_tone_and_drops_a_high_one(up, down):
    t = np.arange(16000) / 16000
    low, high = (audio.resample(np.sin(2 * np.pi * f * t).astype(np.float32), up, down) for f in (500, 7600))
    at = np.arange(len(low)) * down / up / 16000
    assert len(low) == -(-16000 * up // down)
    assert np.abs(low - np.sin(2 * np.pi * 500 * at))[200:-200].max() < 0.005
    if up < down:
        assert np.abs(high[200:-200]).max() < 0.1


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 3), (5, 8), (160, 441), (3, 2)])
def test_resampling_is_a_convolution(up, down):
    x = np.random.default_rng(0).normal(size=700).astype(np.float32)
    half = int(np.ceil(audio.TAPS * max(1, down / (2 * up))))
    for k, y in list(enumerate(audio.resample(x, up, down)))[::13]:
        at, total, weight = k * down / up, 0.0, 0.0
        for j in range(int(np.floor(k * down / up)) - half, int(np.floor(k * down / up)) + half + 1):
            h = np.sinc(min(1, up / down) * (j - at)) * (0.5 + 0.5 * np.cos(np.pi * np.clip((j - at) / (half + 1), -1, 1)))
            weight += h
            total += h * x[j] if 0 <= j < len(x) else 0
        assert y == pytest.approx(total / weight, abs=1e-4)


def test_log_mel_and_features_against_a_plain_transform(spark, sf, docs_001):
    def brute(payload):
        x = audio.resample((np.frombuffer(payload, dtype=np.uint8).astype(np.float32) - 128) / 128)
        rate, frames = 10000, []
        for n in range(max(1, -(-max(0, len(x) - audio.WINDOW) // audio.HOP) + 1)):
            frame = np.zeros(audio.WINDOW)
            part = x[n * audio.HOP : n * audio.HOP + audio.WINDOW]
            frame[: len(part)] = part
            power = np.abs(np.fft.fft(frame * np.hanning(audio.WINDOW + 2)[1:-1]))[: audio.FFT // 2 + 1] ** 2
            frames.append(np.log10(power @ audio.mel_bank(rate).astype(float) + 1e-10))
        return np.array(frames)

    some = spark.createDataFrame([(i, docs_001[i]) for i in list(docs_001)[:25]], "doc_id long, text string")
    for r in audio.audio_features(audio.text_clips(some), "doc_id").collect():
        data = docs_001[r.doc_id].encode()
        mel = brute(data.ljust(max(64, -(-len(data) // 64) * 64), b"\0"))
        chunks = audio.read_tensors(r.tensors)
        stored = chunks.column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)[: r.n_frames]
        assert r.n_frames == len(mel) == sum(chunks.column("n_frames").to_pylist())
        assert np.abs(stored - mel).max() < 0.01
        spans = [(a * audio.HOP / 10000, ((e - 1) * audio.HOP + audio.WINDOW) / 10000) for a, e in audio.segments(stored)]
        assert [(s.start_s, s.end_s) for s in r.segments] == spans


def test_hysteresis_against_a_loop():
    r = np.random.default_rng(1)
    for _ in range(50):
        mel = np.repeat(r.random(80)[:, None], 3, axis=1)
        level, on, spans = (mel[:, 0] - mel.min()) / (mel.max() - mel.min()), None, []
        for i, v in enumerate([*level, -1.0]):
            if on is None and v >= audio.HIGH:
                on = i
            elif on is not None and v < audio.LOW:
                spans, on = [*spans, (on, i)] if i - on >= audio.LEAST else spans, None
        assert audio.segments(mel) == spans


def test_edges_of_audio(edge_docs, no_docs, edge_texts):
    got = audio.audio_features(audio.text_clips(edge_docs), "doc_id").collect()
    assert len(got) == len(edge_texts) + 1
    assert {r.payload_bytes for r in got if r.doc_id in (0, 1)} == {64}
    assert audio.audio_features(audio.text_clips(no_docs), "doc_id").collect() == []
    odd = [(1, None), (2, bytearray(b"no wav file at all")), (3, bytearray(b"RIFF\0\0\0\0WAVEfmt \x10\0")), (None, bytearray())]
    got = audio.audio_features(edge_docs.sparkSession.createDataFrame(odd, "id long, media binary"), "id").collect()
    assert all(r.reason and r.payload_bytes is None and r.tensors is None for r in got) and len(got) == 4


def test_language_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = language_id.op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert np.mean([r.accepted for r in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_rare_languages_stay_in_the_sample(spark):
    lang = F.when(F.col("doc_id") < 20, "rare").otherwise(F.concat(F.lit("l"), (F.col("doc_id") % 11).cast("string")))
    docs = spark.range(22020).select(F.col("id").alias("doc_id")).select("doc_id", F.concat(F.lit("word "), F.col("doc_id").cast("string")).alias("text"), lang.alias("lang"))
    counts = Counter(x.lang for x in language_id.sample(docs, F.lit(True)) if x.lang)
    assert counts.pop("rare") == 20
    assert set(counts.values()) == {(language_id.MOST - 20) // 11} and len(counts) == 11
    many = docs.withColumn("lang", F.when(F.col("doc_id") < 600, F.col("doc_id").cast("string")).otherwise("l"))
    counts = Counter(x.lang for x in language_id.sample(many, F.lit(True)) if x.lang)
    assert len(counts) == 601 and counts["l"] == language_id.SAMPLE


def small_model():
    rows = [language_id.examples(f"{a} {n} " * 5, g) for n in range(20) for a, g in (("the cat and the dog", "en"), ("der hund und die katze", "de"))]
    return language_id.train(sum(rows, []))


def brute_prediction(model, text):
    """The grams of each word with its border marks, one by one."""
    sums, counts, known = [0] * len(model.langs), 0, 0
    classes = bytes(int(c) for c in language_id.CLASSES)
    for word in re.findall(rb"[^\0]+", (text or "").encode().translate(classes)):
        word = b"\0" + word + b"\0"
        for n in language_id.GRAMS:
            for k in range(len(word) - n + 1):
                h = n
                for c in word[k : k + n]:
                    h = (h * 0x01000193 + c) % 2**32
                h = (h ^ h >> 15) * 0x85EBCA6B % 2**32 >> 32 - language_id.BITS
                counts, known = counts + 1, known + bool(model.seen[h])
                sums = [a + int(b) for a, b in zip(sums, model.folded[h], strict=True)]
    x = np.array(sums) / (max(counts, 1) * language_id.SCALE) + model.bias
    p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    return model.langs[int(p.argmax())], float(p.max()), known / max(counts, 1)


def test_predictions_are_brute_force(edge_texts):
    model = small_model()
    texts = [*edge_texts.values(), "der die das " * 50, "x", "ab", "ÄÖ ü", "the cat, und die katze!"]
    for text, lang, score, ok in zip(texts, *language_id.predict(model, texts), strict=True):
        expected, sure, share = brute_prediction(model, text)
        if text and any(c.isalpha() for c in text):
            assert lang == expected and score == pytest.approx(sure) and ok == (sure * share >= model.threshold)
        else:
            assert (lang, score, ok) == ("und", 0.0, False)


def test_junk_and_foreign_texts_are_rejected(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = language_id.fit(docs, F.col("doc_id").isNotNull() & ~language_id.held_out())
    held = [r for r in docs.where(language_id.held_out()).collect() if r.text and r.lang]
    lang, _, ok = language_id.predict(model, [r.text for r in held])
    right = [g == r.lang for g, r, a in zip(lang, held, ok, strict=True) if a]
    assert np.mean(right) >= language_id.PRECISION and np.mean(ok) > 0.98
    noise = [j for r in held for j in language_id.junk(r.text[::-1]) if len(j) > 40]
    assert np.mean(language_id.predict(model, noise)[2]) < 0.03
    foreign = ["Tämä on suomenkielinen teksti, jota malli ei ole koskaan nähnyt, ja se pitäisi hylätä.", "To jest tekst po polsku, którego model nigdy nie widział.", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ= kJ8dj2K9ddjK2 kfjDKJ39dkjf", "漢字 カナ かな 한국어 텍스트"]
    assert language_id.predict(model, foreign)[2] == [False] * 4


def test_edges_of_language_id(edge_docs, no_docs, edge_texts):
    model = small_model()
    got = {r.doc_id: r for r in language_id.identify(edge_docs, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {0, 1, 2}
    assert all(r.score == 0 and not r.accepted for i, r in got.items() if i < 3)
    assert language_id.identify(no_docs, model).collect() == []
    assert {r.lang_pred for r in language_id.identify(edge_docs, None).collect()} == {"und"}
    assert language_id.fit(no_docs, F.lit(True)) is None
    # batches and pieces don't change a score
    long = "der hund " * 300_000
    alone = language_id.predict(model, [long])
    together = language_id.predict(model, ["x", long, None])
    assert alone[1][0] == together[1][1]


def test_a_task_encodes_and_decodes_in_one_worker(edge_docs):
    plan = bpe.encode_decode(edge_docs, PATH)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
