"""Spark jobs for timed-speech corpora: words, segments, subtitles, clips and their checks."""
