"""Column helpers, small p×p algebra and distribution tails."""
