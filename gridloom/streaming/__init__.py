"""Extensions on streams; the job itself has none."""
