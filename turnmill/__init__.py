"""Turnmill: agent-session logs and chat tables to supervised fine-tuning data, on Spark."""
