"""Rules as data, and plans composed of operators."""
