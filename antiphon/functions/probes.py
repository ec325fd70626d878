"""Capability probes."""

# Id, instruction, the pattern that the whole answer must have, and a right answer.
PROBES = (
    ("addition_42", "What is 17 + 25? Reply with only the number.", r"\A\s*42\s*[.!]?\s*\z", "42"),
    ("multiplication_56", "What is 7 times 8? Reply with only the number.", r"\A\s*56\s*[.!]?\s*\z", "56"),
    ("parentheses_27", "Calculate 3 * (4 + 5). Reply with only the number.", r"\A\s*27\s*[.!]?\s*\z", "27"),
    ("grammar_agreement", "Correct the grammar of this sentence. Output only the corrected sentence: She don't like coffee.", r"\A\s*she\s+does(?:n['’]t|\s+not)\s+like\s+coffee[.!]?\s*\z", "She doesn't like coffee."),
    ("past_tense", "What is the simple past tense of 'go'? Reply with only the word.", r"\A\s*went[.!]?\s*\z", "went"),
    ("singular_noun", "What is the singular form of 'children'? Reply with only the word.", r"\A\s*child[.!]?\s*\z", "child"),
    ("python_len", "Write one Python expression that returns the number of elements in the list named items. Output only the expression.", r"\Alen\s*\(\s*items\s*\)\z", "len(items)"),
    ("python_power", "What does Python print(2 ** 3) print? Reply with only the output.", r"\A\s*8\s*\z", "8"),
    ("javascript_boolean", "What Boolean value does the JavaScript expression 2 === 2 produce? Reply with only true or false.", r"\A\s*true[.!]?\s*\z", "true"),
    ("deduction", "All squares are rectangles. All rectangles are shapes. Are all squares shapes? Reply with only yes or no.", r"\A\s*yes[.!]?\s*\z", "yes"),
    ("reading_count", "Maya has three red marbles and two blue marbles. How many marbles does she have in total? Reply with only the number.", r"\A\s*5[.!]?\s*\z", "5"),
    ("alphabetical_order", "Put these words in alphabetical order: pear, apple, banana. Reply with only the three words separated by commas.", r"\A\s*apple\s*,\s*banana\s*,\s*pear[.!]?\s*\z", "apple, banana, pear"),
)
