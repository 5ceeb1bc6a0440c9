"""Schemas of the relations that operators exchange."""

WORD = "struct<start: double, end: double, word: string, probability: double>"
SEGMENT = f"rec_id long, seg_no long, seek long, start double, end double, text string, tokens array<int>, avg_logprob double, compression_ratio double, no_speech_prob double, words array<{WORD}>, temperature double"
INTERVAL = "rec_id long, k long, start long, end long"
CHUNK = "offset double, duration double, segments array<struct<start: long, end: long>>"
ATTEMPT = "rec_id long, seg_no long, attempt int, temperature double, avg_logprob double, compression_ratio double, no_speech_prob double"
EDIT_OP = "array<struct<tag: string, ref: string, hyp: string>>"
CONFUSION = "tp long, fp long, fn long, tn long"
