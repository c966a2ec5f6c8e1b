"""DataFrame-in, DataFrame-out operators over recordings, words, sentences and cues."""
