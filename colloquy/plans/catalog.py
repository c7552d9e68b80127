"""All query modules, imported so that they register."""

from colloquy.plans import audio, diarize, embeddings, events, intervals, live, meetings, peripheral, sources, streams, texts  # noqa: F401
